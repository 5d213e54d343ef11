"""Fixed-capacity containers filled with documents, best-two-fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmill.common import cut
from snapmill.llm import tokens

#: Tokens that one task packs. Each task leaves one container part-filled, in some thousands.
GROUP_TOKENS = 1 << 22


class Stock:
    """Unpacked documents by size: the largest size up to a limit, and the two that together come nearest to one."""

    def __init__(self, sizes: np.ndarray) -> None:
        order = np.argsort(sizes, kind="stable")
        self.sizes, starts, counts = np.unique(sizes[order], return_index=True, return_counts=True)
        self.left = counts.astype(np.int64)
        self.rows, self.starts = order, starts
        self.total = len(sizes)

    def take(self, k: int) -> int:
        self.left[k] -= 1
        self.total -= 1
        row = int(self.rows[self.starts[k] + self.left[k]])
        if not self.left[k]:
            keep = self.left > 0
            self.sizes, self.left, self.starts = self.sizes[keep], self.left[keep], self.starts[keep]
        return row

    def best(self, limit: int) -> int:
        """Place of the largest size up to ``limit``, -1 if there is none."""
        return int(np.searchsorted(self.sizes, limit, "right")) - 1

    def best_two(self, limit: int) -> tuple[int, int, int]:
        """Sum and places of the two documents whose sum is the largest up to ``limit``; sum -1 if there are none."""
        if self.total < 2:
            return -1, -1, -1
        other = np.searchsorted(self.sizes, limit - self.sizes, "right") - 1
        alone = (other == np.arange(len(other))) & (self.left < 2)
        other = other - alone  # one document can't be taken twice
        sums = np.where(other >= 0, self.sizes + self.sizes[other], -1)
        k = int(np.argmax(sums))
        return int(sums[k]), k, int(other[k])


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and position of each item; sizes are at most ``capacity``.

    A container is filled greedily, each time with the largest document that fits. Then its smallest document is exchanged for two
    unpacked ones that fill the room of both more tightly, as long as such two exist.
    """
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stock, number = Stock(sizes), 0
    while stock.total:
        rows, gap = [], capacity
        while stock.total and (k := stock.best(gap)) >= 0:
            gap -= int(stock.sizes[k])
            rows.append(stock.take(k))
        while gap and rows:
            least = int(sizes[rows[-1]])  # greedy filling ends with the smallest
            total, a, b = stock.best_two(gap + least)
            if total <= least:
                break
            first, second = sorted((a, b), reverse=True)
            two = [stock.take(first), 0]
            two[1] = stock.take(second)
            back = rows.pop()
            rows += two
            rows.sort(key=lambda r: -sizes[r])
            stock = put(stock, sizes, back)
            gap += least - total
        bins[rows], places[rows] = number, np.arange(len(rows))
        number += 1
    return bins, places


def put(stock: Stock, sizes: np.ndarray, row: int) -> Stock:
    """Gives a document back to the stock."""
    size = int(sizes[row])
    k = int(np.searchsorted(stock.sizes, size))
    if k < len(stock.sizes) and stock.sizes[k] == size:
        # the documents of one size are alike, so the one given back goes to the end of those left
        stock.rows[stock.starts[k] + stock.left[k]] = row
        stock.left[k] += 1
    else:
        stock.rows = np.append(stock.rows, row)
        stock.sizes = np.insert(stock.sizes, k, size)
        stock.left = np.insert(stock.left, k, 1)
        stock.starts = np.insert(stock.starts, k, len(stock.rows) - 1)
    stock.total += 1
    return stock


def packed(docs: DataFrame, sizes: DataFrame, *, folder: str = tokens.FOLDER, file: str = tokens.FILE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Container and position of every document for each row of ``sizes`` (``pack_name, capacity_tokens``).

    Returns ``pack_name, doc_id, piece, pieces, n_tokens, container, position``. A document beyond the capacity is split into
    full pieces, each alone in a container, and a rest that is packed like any other; no other is split. A null or empty text has size 0 and is placed as well. Repeated rows are placed as often. Rows of ``sizes`` without a positive
    capacity are ignored, as are other columns of either table. Empty tables give an empty result. Documents are spread over groups of about
    ``group_tokens`` by a hash; a task packs the sizes of one group, never their texts.
    """
    # sizes are written once, and with them a number per row, so that repeated rows keep apart whatever is recomputed
    counted = cut(tokens.sized(docs.select("doc_id", F.lit(None).cast("string").alias("source"), "text"), folder, file).select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row")))
    total = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    groups = max(1, -(-total["t"] // group_tokens), -(-total["n"] // (group_tokens // 16)))
    capacities = [(r["pack_name"], r["capacity_tokens"]) for r in sizes.select("pack_name", "capacity_tokens").where("capacity_tokens > 0").distinct().collect()]  # a list of settings
    wanted = F.array(*(F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in capacities)) if capacities else F.array().cast("array<struct<pack_name:string,capacity:bigint>>")
    items = counted.select("doc_id", "row", "n_tokens", F.explode(wanted).alias("w")).select("doc_id", "row", "n_tokens", "w.*")
    pieces = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1))
    split = items.withColumn("pieces", pieces.cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    split = split.withColumn("size", F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity"))).withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bins, places = pack(frame["size"].to_numpy(), int(frame["capacity"].iloc[0]))
        return pd.DataFrame({"pack_name": frame["pack_name"], "doc_id": frame["doc_id"], "piece": frame["piece"], "pieces": frame["pieces"], "n_tokens": frame["size"], "container": key[2] * (1 << 40) + bins, "position": places})

    return split.groupBy("pack_name", "capacity", "group").applyInPandas(run, "pack_name string, doc_id bigint, piece int, pieces int, n_tokens bigint, container bigint, position int")


def oversize(placed: DataFrame) -> DataFrame:
    """Documents that alone exceed a capacity: ``pack_name, doc_id``."""
    return placed.where("pieces > 1").select("pack_name", "doc_id").distinct()


def fill(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per capacity the number of containers and pieces and the share of all room that is used."""
    used = placed.groupBy("pack_name").agg(F.count_distinct("container").alias("containers"), F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return used.join(sizes.select("pack_name", "capacity_tokens").distinct(), "pack_name").withColumn("used_share", F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 6))
