import numpy as np
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from snapmill.common import load
from snapmill.llm import packing, tokens


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.integers(10, 400))
    sizes = np.minimum(r.geometric(0.02, int(r.integers(1, 400))), capacity) * (r.random() < 0.9) if seed else np.array([], int)
    bins, places = packing.pack(sizes, capacity)
    filled = np.bincount(bins, sizes, minlength=1) if len(sizes) else np.zeros(1)
    assert filled.max() <= capacity
    assert len({*zip(bins.tolist(), places.tolist(), strict=True)}) == len(sizes)
    for b in np.unique(bins):
        assert sorted(places[bins == b]) == list(range((bins == b).sum()))


def test_two_fit_beats_greedy():
    """Greedy takes 7 and 2 of 10; exchanging the 2 for two smaller ones that fill the room is tighter."""
    sizes = np.array([7, 2, 1, 1, 1])
    bins, _ = packing.pack(np.array([6, 3, 2, 2]), 10)
    assert np.bincount(bins, [6, 3, 2, 2]).max() == 10
    assert packing.pack(sizes, 10)[0].max() == 1
    stock = packing.Stock(np.array([2, 2, 5]))
    assert stock.best_two(4)[0] == 4 and stock.best_two(3)[0] == -1 and stock.best_two(7)[0] == 7


def test_all_documents_of_the_small_tables(spark):
    d = f"{DATA}/sf0.01"
    docs, sizes = load(spark, d, "documents"), load(spark, d, "pack_sizes")
    placed = packing.packed(docs, sizes, group_tokens=1 << 17).toPandas()
    for name, capacity in ((r.pack_name, r.capacity_tokens) for r in sizes.collect()):
        own = placed[placed.pack_name == name]
        assert own[own.piece == 0].doc_id.nunique() == docs.count()
        assert own.groupby("container").n_tokens.sum().max() <= capacity
        assert not own.duplicated(["container", "position"]).any()
        full = own.groupby("doc_id").agg(n=("n_tokens", "sum"), pieces=("pieces", "first"), rows=("piece", "count"))
        assert (full.pieces == full.rows).all() and (full.pieces == np.maximum(-(-full.n // capacity), 1)).all()
        assert own.n_tokens.sum() / own.container.nunique() / capacity > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 3000), (3, "word " * 3000), (4, "a b c"), (None, "x")], "doc_id bigint, text string").withColumn("piece", F.lit(9)).withColumn("group", F.lit("x")).withColumn("row", F.lit(1))
    sizes = spark.createDataFrame([("s", 1000), ("s", 1000), ("none", 0), (None, None)], "pack_name string, capacity_tokens int")
    placed = packing.packed(docs, sizes)
    assert rows(packing.oversize(placed)) == [("s", 3)]
    assert placed.where("doc_id = 3").count() == 2 * max(r.pieces for r in placed.collect())
    assert placed.where("doc_id is null or doc_id in (1, 2, 4)").count() == 4
    assert packing.packed(docs.limit(0), sizes).count() == 0
    assert packing.packed(docs, sizes.limit(0)).count() == 0


def test_long_texts_are_encoded_whole():
    text = "".join(f"word{i} " for i in range(40_000))
    encode = tokens.encoder()
    assert sum(len(encode(p)) for p in tokens.pieces(text)) == len(tokens.ids(text))
    assert "".join(tokens.pieces(text)) == text
    assert abs(len(tokens.ids(text)) - len(encode(text))) < 40
    assert "".join(tokens.pieces("x" * 200_000)) == "x" * 200_000


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_tokenizers(file):
    assert len(tokens.ids("Wait events of the database.", file=file)) in range(4, 12)
