import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from snapmill.common import load
from snapmill.llm import mixing


def test_shares_of_the_small_tables(spark):
    d = f"{DATA}/sf0.01"
    docs, targets = load(spark, d, "documents"), load(spark, d, "mix_targets")
    chosen = mixing.mixed(docs, targets).cache()
    most = {r.source: r.max_repeats for r in targets.collect()}
    got = chosen.collect()
    assert all(0 <= r.repeats <= most[r.source] for r in got)
    assert len(got) == docs.where(F.col("source").isin([*most])).count()
    for r in mixing.reached(chosen, targets).collect():
        if r.short:
            assert all(x.repeats == most[x.source] for x in got if x.source == r.source)
        else:
            assert abs(r.share_of_s - r.target_share) < 0.001
    chosen.unpersist()


def test_whole_repeats_keep_tokens():
    r = np.random.default_rng(4)
    sizes = np.sort(r.geometric(0.01, 500))[::-1]
    for rate in (0.1, 0.5, 1.37, 2.0):
        got = mixing.whole(sizes, np.full(500, rate), np.full(500, 2.0))
        assert got.max() <= 2
        assert abs((got * sizes).sum() - rate * sizes.sum()) <= sizes[-1] + 1


WORDS = {"a": "alpha beta gamma", "b": "one two three"}


def told_apart(spark, n=400):
    """Documents of two sources; of every tenth the text is the other source's."""
    rows = [(i, s, " ".join([WORDS["ab"["ab".index(s) ^ (i % 20 < 2)]]] * (5 + i % 9))) for i, s in enumerate("ab" * (n // 2))]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def test_classifier_tells_sources_apart(spark):
    docs = spark.createDataFrame([(i, s, " ".join([WORDS[s]] * 20)) for i, s in enumerate("ab" * 40)], "doc_id bigint, source string, text string")
    found = mixing.classifier(docs, ["a", "b"], mixing.tokens.FOLDER, mixing.tokens.FILE)
    assert found.accuracy == 1.0 and found.majority == 0.5
    swapped = docs.withColumn("text", F.lit(" ".join([WORDS["a"]] * 20)))
    p = mixing.members(swapped, ["a", "b"], found, mixing.tokens.FOLDER, mixing.tokens.FILE, trust=0.0)
    assert all(r.p[0] > 0.99 for r in p.collect())
    uneven = mixing.members(docs, ["a", "b"], found, mixing.tokens.FOLDER, mixing.tokens.FILE, trust=0.9)
    assert all(r.p[r.code] > 0.9 for r in uneven.collect())
    noise = docs.withColumn("text", F.concat_ws(" ", F.hash("doc_id").cast("string"), F.hash(F.col("doc_id") + 7).cast("string")))
    assert mixing.classifier(noise, ["a", "b"], mixing.tokens.FOLDER, mixing.tokens.FILE).evidence < 0.3


def test_expected_and_recorded_totals_meet_the_targets(spark):
    docs = told_apart(spark)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 2)], "source string, target_share double, max_repeats int")
    for r in mixing.reached(mixing.mixed(docs, targets), targets).collect():
        assert not r.short and abs(r.share_of_s - r.target_share) < 0.01 * r.target_share
        assert abs(r.expected_share - r.target_share) < 0.01 * r.target_share


def test_fit_and_classifier_decide(spark, monkeypatch):
    """Without the fit no source is at its bound, and without the classifier other documents are chosen."""
    docs = told_apart(spark)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen = lambda: {r.doc_id: r.repeats for r in mixing.mixed(docs, targets).collect()}
    short = lambda: {r.source for r in mixing.reached(mixing.mixed(docs, targets), targets).collect() if r.short}
    usual, bound = chosen(), short()
    assert bound == {"b", "c"}
    with monkeypatch.context() as m:
        m.setattr(mixing, "fitted", lambda cells, most, goal: np.full(len(cells), 0.5))
        assert "b" not in short() and chosen() != usual
    with monkeypatch.context() as m:
        blind = mixing.Classifier(np.full((3, mixing.FEATURES), -1.0), np.log(np.full(3, 1 / 3)))
        m.setattr(mixing, "classifier", lambda *a, **k: blind)
        assert chosen() != usual


def test_descent_ends_where_no_rate_can_do_better():
    r = np.random.default_rng(3)
    for _ in range(20):
        rows, sizes, top = r.random((5, 30)) * 0.1, r.random(30), r.integers(1, 4, 30).astype(float)
        goal = r.random(5)
        x = mixing.descend(rows, goal, sizes, top, np.ones(30), 1e-10, 20_000)
        gradient = rows.T @ (rows @ x - goal)
        assert (gradient[x < 1e-9] > -1e-5).all() and (gradient[x > top - 1e-9] < 1e-5).all()
        assert np.abs(gradient[(x > 1e-9) & (x < top - 1e-9)]).max(initial=0) < 1e-4


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_shares_follow_from_the_chosen(spark, folder):
    from snapmill.llm import plans

    d = f"{DATA}/{folder}"
    chosen = plans.p9_chosen(spark, d).toPandas()
    sizes = mixing.tokens.sized(load(spark, d, "documents")).toPandas().drop_duplicates("doc_id").set_index("doc_id")["n_tokens"]
    own = (chosen["repeats"] * chosen["doc_id"].map(sizes)).groupby(chosen["source"]).sum()
    for r in plans.p9_shares(spark, d).collect():
        assert r.tokens == own.get(r.source, 0) and abs(r.share - own.get(r.source, 0) / own.sum()) < 1e-6


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", "x y z " * 40_000), (4, None, "x"), (5, "zzz", "x"), (6, "b", "x y"), (6, "b", "x y"), (None, "b", "q")], "doc_id bigint, source string, text string").withColumn("rate", F.lit("x")).withColumn("row", F.lit(1)).withColumn("p", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.1, 2), (None, 0.1, 1), ("d", None, 1)], "source string, target_share double, max_repeats int")
    chosen = mixing.mixed(docs, targets)
    got = chosen.collect()
    assert len(got) == 6 and all(r.repeats <= (3 if r.source == "b" else 1) for r in got)
    assert sum(r.repeats for r in got if r.source == "b") == 9
    assert {r.source for r in mixing.reached(chosen, targets).collect() if r.short} == {"b", "c"}
    assert mixing.mixed(docs, targets.limit(0)).count() == 0
    empty = mixing.mixed(docs.limit(0), targets)
    assert empty.count() == 0
    assert {r.source for r in mixing.reached(empty, targets).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("share", [0.2])
def test_hot_source(spark, share):
    """A source with most rows is brought down to its share like any other."""
    docs = spark.createDataFrame([(i, "hot" if i % 10 else "cold", "some words here " * (1 + i % 7)) for i in range(1500)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("hot", share, 1), ("cold", 0.1, 3)], "source string, target_share double, max_repeats int")
    got = {r.source: r.share_of_s for r in mixing.reached(mixing.mixed(docs, targets), targets).collect()}
    assert abs(got["hot"] - share) < 0.005 and abs(got["cold"] - 0.1) < 0.005
