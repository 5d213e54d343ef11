import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from snapmill.common import load
from snapmill.llm import reading


def test_held_out_accuracy(spark):
    """Fitted on the labels of even documents, right on odd ones whose readers agree."""
    d = f"{DATA}/sf0.1"
    docs, labels = load(spark, d, "documents"), load(spark, d, "reading_labels")
    got = reading.levels(docs, labels.where("doc_id % 2 = 0"))
    agreed = labels.where("doc_id % 2 = 1 and read_level is not null").groupBy("doc_id").agg(F.min("read_level").alias("a"), F.max("read_level").alias("z"), F.count(F.lit(1)).alias("n")).where("a = z and n > 1")
    both = agreed.join(got, "doc_id").collect()
    assert len(both) > 200
    assert np.mean([r.a == r.read_level for r in both]) > 0.97


def test_prose():
    prose = "Look at the disk first. It took 3 hours!\n- We had to wait\n"
    table = "log file sync   265,750    549.2  31.01\nEnd Snap:\n~~~~~\n(attachment removed)\n-\nSummary\n"
    assert [" ".join(s) for s in reading.sentences(prose + table)] == ["at disk first look the", "hours it took", "had to wait we"]
    assert reading.sentences(table) == reading.sentences(None) == reading.sentences("") == []


def test_prose_of_any_script():
    assert [len(s) for s in reading.sentences("服务器很慢。请检查日志，然后重启数据库！")] == [5, 12]
    assert len(reading.sentences("डेटाबेस धीमा है। कृपया लॉग देखें।")) == 2
    assert reading.sentences("डेटाबेस धीमा है।") == [sorted(["डेटाबेस", "धीमा", "है"])]
    assert len(reading.sentences("the disk was full last night\nso we moved the old files away")) == 2
    assert reading.sentences("(attachment removed)") == reading.sentences("Event   Waits  Time(s)") == reading.sentences("SELECT A, B FROM T WHERE ID = 3") == []


def test_unknown_words_have_the_usual_level(spark):
    docs = spark.createDataFrame([(i, "Every cat sleeps here." if i % 5 else "Some axiom holds there.") for i in range(60)] + [(99, "Quux frob blarg zork.")], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 2 if i % 5 else 4) for i in range(60)], "doc_id bigint, read_level int")
    got = {r.doc_id: (r.read_level, r.certainty) for r in reading.levels(docs, labels).collect()}
    assert got[99] == (2, 0.25)


def test_neighbouring_sentences_dont_change_a_level(spark):
    words = {1: ["cat", "dog", "sun"], 2: ["disk", "index", "query"], 3: ["latency", "contention", "threshold"], 4: ["paradigm", "axiom", "lemma"]}
    text = lambda level, n, other=1, more=0: " ".join(f"{w.capitalize()} and {w} are here." for w in [*(words[level] * n)[:n], *(words[other] * 9)[:more]])
    docs = spark.createDataFrame([(i, text(i % 4 + 1, 8), None) for i in range(120)] + [(1000 + k, text(k, 9, k + 1 if k < 4 else 3, 3), "en") for k in words], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 4 + 1) for i in range(120)] + [(0, 4), (1, 3), (3, None), (5, 9), (999, 1)], "doc_id bigint, read_level int")
    got = {r.doc_id: r.read_level for r in reading.levels(docs, labels).collect()}
    assert got == {i: i % 4 + 1 for i in range(120)} | {1000 + k: k for k in words}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "-", None), (4, "A short text is here. " * 20_000, "EN"), (4, "A short text is here.", "en"), (None, "Another one is there.", "de")], "doc_id bigint, text string, lang string").withColumn("read_level", F.lit("x")).withColumn("word", F.lit(1))
    labels = spark.createDataFrame([], "doc_id bigint, read_level int")
    got = sorted((r.doc_id or 0, r.read_level, r.certainty) for r in reading.levels(docs, labels).collect())
    assert got == [(0, 1, 0.25), (4, 1, 0.25), (4, 1, 0.25)]
    assert reading.levels(docs.limit(0), labels).count() == 0
    assert reading.levels(docs, spark.createDataFrame([(4, 2), (4, 2)], "doc_id bigint, read_level int")).count() == 3


def test_curves_recover_difficulty():
    """Words made with known difficulty come back with it."""
    levels = np.arange(1, 5)
    totals = np.full((3, 4), 50_000.0)
    odds = np.array([-3 - 1.0 * (levels - b) ** 2 for b in (1.5, 2.5, 3.5)])
    got = reading.curves(totals / (1 + np.exp(-odds)), totals)
    assert np.abs(got - np.maximum(odds, odds.max(1, keepdims=True) - reading.HOLD)).max() < 0.05
