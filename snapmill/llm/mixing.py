"""Sources mixed to target shares by soft membership.

A classifier of the labelled documents gives each document posteriors over the sources, weighed with the recorded one. Documents of one
source whose posteriors are alike form a cell; Spark sums the tokens and the expected tokens of each cell. Projected-gradient least
squares then finds a rate per cell, between 0 and its source's repeats, whose expected totals and whose recorded totals by source meet
the targets. Each document has the rate of its cell. What the descent holds is bounded by sources and levels, whatever the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapmill.common import cut
from snapmill.llm import tokens

#: Labelled documents per source that the classifier is fitted on, at most about so many; this part of them is held out to calibrate it.
TRAIN_DOCS, HELD_OUT = 2000, 0.2
#: Features: token ids modulo this.
FEATURES = 1 << 14
#: Weight of the recorded source in a document's posterior; the classifier has the rest.
TRUST = 0.9
#: Weights of the classifier's evidence per token that calibration chooses from.
EVIDENCE = (0.0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
#: Steps of a document's greatest posterior that cells tell apart.
LEVELS = 16
#: The projected gradient, as a share of the size, at which the descent ends.
ENOUGH = 1e-7
#: Tokens whose weights are summed at once.
AT_ONCE = 100_000
#: The smallest documents, this part of a group, get their whole repeats last.
SMALL = 0.2
#: Documents of one source that one task brings to whole repeats, about.
GROUP_DOCS = 1 << 15


@dataclass
class Classifier:
    """``table``: log probability of each feature by source (sources x FEATURES); ``prior``: log share of each source; ``evidence``: weight of a
    token's evidence; ``accuracy``: share of held-out documents whose source is the likeliest, ``majority``: share of the largest source."""

    table: np.ndarray
    prior: np.ndarray
    evidence: float = 1.0
    accuracy: float = 0.0
    majority: float = 0.0

    def posteriors(self, score: np.ndarray, evidence: float | None = None) -> np.ndarray:
        """Posteriors of the sources for rows of summed log probabilities."""
        raw = self.prior + (self.evidence if evidence is None else evidence) * score
        out = np.exp(raw - raw.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def features(text: str | None, folder: str, file: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's features, and how often each counts: one text that repeats a word doesn't make its source."""
    which, counts = np.unique(np.array(tokens.ids(text, folder, file), np.int64) % FEATURES, return_counts=True)
    return which, np.minimum(counts, 3)


def classifier(docs: DataFrame, sources: list[str], folder: str, file: str, train_docs: int = TRAIN_DOCS) -> Classifier:
    """Naive Bayes over tokens, from a sample of the labelled documents, its evidence calibrated on the held-out part of the sample.

    What is collected has one row per source and feature that occurs, FEATURES x sources at most.
    """
    labelled = docs.where(F.col("source").isin(sources))
    counts = {r["source"]: r["n"] for r in labelled.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per target
    every = np.array([counts.get(s, 0) for s in sources], float)
    table = np.full((len(sources), FEATURES), 0.5)
    prior = np.log((every + 1) / (every + 1).sum())
    if not counts:
        return Classifier(np.log(table / table.sum(1, keepdims=True)), prior)
    share = F.create_map(*(F.lit(x) for s, n in counts.items() for x in (s, min(1.0, train_docs / n))))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = labelled.select("source", "text", (chance / share[F.col("source")]).alias("at")).where("at < 1")
    learn, held = sample.where(F.col("at") >= HELD_OUT), sample.where(F.col("at") < HELD_OUT)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = np.zeros((len(sources), FEATURES), np.int64)
            for source, text in zip(f["source"], f["text"], strict=True):
                which, n = features(text, folder, file)
                own[sources.index(source), which] += n
            s, k = np.nonzero(own)
            yield pd.DataFrame({"s": s.astype(np.int32), "k": k.astype(np.int32), "n": own[s, k]})

    sums = tokens.spread(learn.select("source", "text")).mapInPandas(count, "s int, k int, n bigint").groupBy("s", "k").agg(F.sum("n").alias("n")).toPandas()
    table[sums["s"], sums["k"]] += sums["n"]
    found = Classifier(np.log(table / table.sum(1, keepdims=True)), prior)
    sent = docs.sparkSession.sparkContext.broadcast(found)  # FEATURES x sources numbers

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            score, _ = scores(f["text"], sent.value.table.T, folder, file)
            own = np.array([sources.index(s) for s in f["source"]])
            for i, evidence in enumerate(EVIDENCE):
                p = sent.value.posteriors(score, evidence)
                yield pd.DataFrame({"i": [i], "gain": [float(np.log(np.maximum(p[np.arange(len(f)), own], 1e-12)).sum())], "hits": [int((p.argmax(1) == own).sum())], "n": [len(f)]})

    tested = tokens.spread(held.select("source", "text")).mapInPandas(test, "i int, gain double, hits bigint, n bigint").groupBy("i").agg(F.sum("gain").alias("gain"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).orderBy("i").toPandas()
    if len(tested):
        best = tested.sort_values(["gain", "i"], ascending=[False, True]).iloc[0]
        found.evidence, found.accuracy, found.majority = EVIDENCE[int(best["i"])], float(best["hits"] / best["n"]), float(every.max() / every.sum())
    return found


def scores(texts: pd.Series, weights: np.ndarray, folder: str, file: str) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sums of its tokens' weights by source, and its size."""
    out, sizes = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    first = 0
    for i, text in enumerate(texts):
        held.append(np.array(tokens.ids(text, folder, file), np.int64))
        sizes[i] = len(held[-1])
        if sizes[first : i + 1].sum() < AT_ONCE and i + 1 < len(texts):
            continue
        full = np.flatnonzero(sizes[first : i + 1])
        if len(full):
            starts = np.cumsum(sizes[first : i + 1])[full] - sizes[first + full]
            out[first + full] = np.add.reduceat(weights[np.concatenate(held) % FEATURES], starts)
        held, first = [], i + 1
    return out, sizes


def members(docs: DataFrame, sources: list[str], found: Classifier, folder: str, file: str, trust: float = TRUST) -> DataFrame:
    """``doc_id, code, n_tokens, cell, p``: the place of the recorded source in ``sources``, the document's cell, and the posterior of each
    source, the recorded one weighed with the classifier's. A cell is the recorded source, the classifier's likeliest one and how likely."""
    sent = docs.sparkSession.sparkContext.broadcast(found)  # FEATURES x sources numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.ascontiguousarray(sent.value.table.T)
        for f in frames:
            score, sizes = scores(f["text"], weights, folder, file)
            table = sent.value.posteriors(score)
            code = pd.Index(sources).get_indexer(f["source"])
            likeliest = table.argmax(1) if len(f) else np.zeros(0, np.int64)
            level = np.minimum((table.max(1, initial=0.0) * LEVELS).astype(np.int64), LEVELS - 1)
            table *= 1 - trust
            table[np.arange(len(f)), code] += trust
            yield pd.DataFrame({"doc_id": f["doc_id"], "code": code, "n_tokens": sizes, "cell": (code * len(sources) + likeliest) * LEVELS + level, "p": list(table)})

    return tokens.spread(docs.where(F.col("source").isin(sources)).select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, code int, n_tokens bigint, cell bigint, p array<double>")


def descend(rows: np.ndarray, goal: np.ndarray, sizes: np.ndarray, top: np.ndarray, rates: np.ndarray, enough: float, rounds: int) -> np.ndarray:
    """Projected-gradient least squares with momentum: rates between 0 and ``top`` with the least squared difference of ``rows @ rates`` and
    ``goal``. Rates are scaled by the root of their cell's size. Ends when the projected gradient is below ``enough``."""
    scale = 1 / np.sqrt(np.maximum(sizes, 1e-12))
    scaled = rows * scale
    step = 1 / max(float(np.linalg.norm(scaled, 2)) ** 2, 1e-12)
    x = kept = rates / scale
    momentum = 1.0
    for _ in range(rounds):
        moved = np.clip(kept - step * (scaled.T @ (scaled @ kept - goal)), 0.0, top / scale)
        if np.abs((moved - kept) * scale * sizes).sum() < enough:
            x = moved
            break
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        kept = moved + (momentum - 1) / following * (moved - x) if ((kept - moved) * (moved - x)).sum() <= 0 else moved
        momentum = following if kept is not moved else 1.0
        x = moved
    return np.clip(x * scale, 0.0, top)


#: Weight of recorded totals against expected ones in the common fit, and rounds of the descent at most; a last one brings the recorded
#: totals, each a sum over cells of its own, to the targets exactly and ends by itself.
RECORDED, ROUNDS = 4.0, 20_000


def fitted(cells: pd.DataFrame, most: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The rate of each cell (``code, n, e``: tokens and expected tokens by source).

    First recorded totals alone, which shows what is reachable; then both kinds of totals; then the recorded ones again, exactly. A source
    whose rates all end at its most repeats, below its goal, is at its bound: no further repeat is left to it.
    """
    k, size = len(goal), max(float(cells["n"].sum()), 1.0)
    code, n = cells["code"].to_numpy(), cells["n"].to_numpy(float) / size
    own = np.zeros((k, len(cells)))
    own[code, np.arange(len(cells))] = n
    soft = np.stack(cells["e"].to_list(), 1) / size if len(cells) else np.zeros((k, 0))
    top, want = most[code], goal / size
    rates = recorded(own, want, n, top, np.minimum(1.0, top))
    reach = own @ rates
    rates = descend(np.vstack((soft, RECORDED * own)), np.concatenate((reach, RECORDED * reach)), n, top, rates, ENOUGH, ROUNDS)
    return recorded(own, want, n, top, rates)


def recorded(own: np.ndarray, want: np.ndarray, n: np.ndarray, top: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Projected-gradient steps on the recorded totals, whose rows share no cell, so that each source has its own step: the difference over
    the tokens of its cells that can still move. Ends when no source moves: at its goal, or with all cells at a bound."""
    while True:
        short = want - own @ rates
        free = np.where(short[:, None] > 0, rates < top, rates > 0) & (own > 0)
        room = (own * free).sum(1)
        step = np.where((np.abs(short) > 1e-12) & (room > 0), short / np.where(room > 0, room, 1.0), 0.0)
        moved = np.clip(rates + ((own > 0) * step[:, None]).sum(0), 0.0, top)
        if np.array_equal(moved, rates) or np.abs(want - own @ moved).sum() >= np.abs(short).sum():
            return rates
        rates = moved


def mixed(docs: DataFrame, targets: DataFrame, *, folder: str = tokens.FOLDER, file: str = tokens.FILE, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The chosen documents: ``doc_id, source, n_tokens, rate, at_bound, expected, repeats``; documents that aren't chosen have 0 repeats.

    S is the size of all documents of the listed sources, each once. Rates are fitted to the targets with soft membership and with the
    recorded sources; a rate becomes a whole number of repeats so that a source's total stays, and nearly that of its cells.
    ``at_bound``: the document's rate is its most repeats. ``expected``: the document's expected tokens by source, used once. Documents with a null or unlisted source take no part.
    Repeated rows count as often. Null and empty texts have size 0. Targets with a null source, share or repeats are ignored; of
    repeated targets of one source the greatest counts. Other columns are ignored. Empty tables give an empty result.
    """
    wanted = targets.where("source is not null and target_share is not null and max_repeats is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).orderBy("source").collect()  # settings
    sources = [r["source"] for r in wanted]
    if not sources:
        return docs.limit(0).select("doc_id", "source", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0.0).alias("rate"), F.lit(False).alias("at_bound"), F.create_map().cast("map<string,double>").alias("expected"), F.lit(0).alias("repeats"))
    found = classifier(docs, sources, folder, file, train_docs)
    table = cut(members(docs, sources, found, folder, file).withColumn("row", F.monotonically_increasing_id()))
    expected = F.array(*(F.sum(F.col("n_tokens") * F.col("p")[k]) for k in range(len(sources)))).alias("e")
    cells = table.groupBy("cell", "code").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("documents"), expected).orderBy("cell").toPandas()  # sources x sources x LEVELS rows at most
    most = np.array([float(r["most"]) for r in wanted])
    rates = fitted(cells, most, float(cells["n"].sum()) * np.array([r["share"] for r in wanted]))
    held = docs.sparkSession.createDataFrame(pd.DataFrame({"cell": cells["cell"], "rate": rates, "at_bound": rates >= most[cells["code"]]}), "cell bigint, rate double, at_bound boolean")
    # whole repeats per hash group of a source, so that its tokens stay
    groups = np.maximum(1, np.bincount(cells["code"], cells["documents"], len(sources)) // GROUP_DOCS).astype(int).tolist()
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("code") + 1)
    rated = table.join(held, "cell").select("doc_id", at(sources).alias("source"), "code", "cell", "n_tokens", "row", "p", "rate", "at_bound", at(most.tolist()).alias("most"), F.pmod(F.xxhash64("doc_id", "row"), at(groups)).alias("group"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        small = frame["n_tokens"] <= frame["n_tokens"].quantile(SMALL)  # these come last, so that what is owed in the end is little
        frame = frame.assign(small=small).sort_values(["small", "cell", "n_tokens", "row"], ascending=[True, True, False, True])
        repeats = whole(frame["n_tokens"].to_numpy(), frame["rate"].to_numpy(), frame["most"].to_numpy())
        expected = [n * p for n, p in zip(frame["n_tokens"], frame["p"], strict=True)]
        return frame[["doc_id", "source", "n_tokens", "rate", "at_bound"]].assign(expected=expected, repeats=repeats)

    chosen = rated.groupBy("source", "group").applyInPandas(run, "doc_id bigint, source string, n_tokens bigint, rate double, at_bound boolean, expected array<double>, repeats int")
    return chosen.withColumn("expected", F.map_from_arrays(F.array(*map(F.lit, sources)), "expected"))


def whole(sizes: np.ndarray, rates: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whole repeats for rates in the given order: what rounding adds or takes in tokens is made up by those after."""
    owed, out = 0.0, np.zeros(len(sizes), np.int32)
    for i, (size, rate, top) in enumerate(zip(sizes.tolist(), rates.tolist(), most.tolist(), strict=True)):
        owed += size * rate
        out[i] = int(min(max(round(owed / size) if size else rate, 0), top))
        owed -= size * out[i]
    return out


def reached(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: ``source, target_share, share`` (of the mix), ``share_of_s, expected_share`` (of S, by soft membership), ``tokens, documents,
    short``.

    ``short``: the fit ended at the source's bound, all rates at the most repeats, with the fitted tokens below the target.
    """
    n, times = F.col("n_tokens"), F.col("repeats")
    spread = chosen.select("source", "n_tokens", "rate", "at_bound", "repeats", F.explode("expected").alias("to", "e"))
    # a row per source of documents and source that they may belong to, targets x targets at most
    sums = spread.groupBy("source", "to").agg(F.sum(n * times).alias("tokens"), F.sum("n_tokens").alias("own"), F.count_if(times > 0).alias("documents"), F.sum(n * F.col("rate")).alias("fitted"), F.count_if((n > 0) & ~F.col("at_bound")).alias("free"), F.sum(F.col("e") * times).alias("e"))
    by, moved = sums.where(F.col("source") == F.col("to")).drop("to", "e"), sums.groupBy(F.col("to").alias("source")).agg(F.sum("e").alias("expected"))
    want = targets.where("source is not null and target_share is not null and max_repeats is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    one = Window.partitionBy(F.lit(1))  # one row per target
    joined = want.join(by, "source", "left").join(moved, "source", "left").select("*", F.sum("tokens").over(one).alias("all"), F.sum("own").over(one).alias("s"))
    part = lambda x, of: F.round(F.coalesce(F.col(x), F.lit(0)) / F.greatest(F.coalesce(F.col(of), F.lit(0)), F.lit(1)), 6)
    short = (F.coalesce("free", F.lit(0)) == 0) & (F.coalesce("fitted", F.lit(0.0)) < F.col("target_share") * F.coalesce("s", F.lit(0)))
    return joined.select("source", "target_share", part("tokens", "all").alias("share"), part("tokens", "s").alias("share_of_s"), part("expected", "s").alias("expected_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), short.alias("short"))
