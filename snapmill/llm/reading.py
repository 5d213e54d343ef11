"""Reading level of documents: a Rasch-style latent difficulty model of word occurrence.

A sentence of level l holds word w with log odds c_w - k_w (l - b_w)^2: b_w is the word's difficulty, k_w how sharply it tells,
c_w how common it is (the unfolding form of the Rasch model, since everyday words are as rare in scholarly text as scholarly
ones in simple text). A document of level L is made of sentences of level L and, seldom, of neighbouring ones. Alternating
optimisation on the labelled documents: levels of sentences and documents given the words, then the words given the levels. Words
are measured among the sentences of their own language, so that a language's share of a level says nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmill.common import cut
from snapmill.llm.tokens import spread

GRADES = np.arange(1, 5)
#: Labelled documents that the model is fitted on, at most about so many.
TRAIN_DOCS = 20_000
#: Sentences of the sample that must hold a word for it to be in the model.
LEAST_SENTENCES = 5
#: Share of the sample's sentences from which a language is one of its own.
LEAST_LANGUAGE = 0.002
#: Rounds at most, and the mean movement of the words' log chances, each weighed by its sentences, below which the rounds have converged.
ROUNDS, SETTLED = 12, 0.1
#: Share of a document's sentences that have its own level; neighbouring levels have most of the rest.
OWN = 0.85
#: Chance that a reader gives the right level; neighbouring ones have most of the rest.
READER = 0.8
#: A word's influence is held within these log odds between levels.
HOLD = 4.0

#: A word: letters with their marks; a character where words are written without blanks.
WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]\p{M}*|\p{L}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+")
WORDS = regex.compile(rf"(?:{WORD.pattern})+")
BULLET = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+")
#: Marks that close a sentence before a blank, and those of scripts that put none after them.
ENDS, FULL_ENDS = ".!?…", "。！？｡।॥؟۔"
END = re.compile(rf"(?<=[{ENDS}])[\"'”’)]*\s+(?=\S)")
WIDE = re.compile(rf"[{FULL_ENDS}，、；：]")
WIDE_END = re.compile(rf"{END.pattern}|(?<=[{FULL_ENDS}])[\"'”’)」』】]*\s*(?=\S)")
WIDE_PIECE = re.compile(r"\s+|(?<=[，、；：])")
CLOSERS, MARKS = "\"'”’)」』】", ".,;:!?…\"'“”„’()[]，、；：「」『』【】" + FULL_ENDS
#: Where nothing is closed: the least words of a line of prose, and their share of its pieces.
LINE_WORDS, LINE_SHARE = 5, 0.8
#: Pieces of text between blanks whose words a worker keeps at hand.
KEPT = 200_000


def near(share: float) -> np.ndarray:
    """4 x 4: the own level with ``share``, others falling off with the distance."""
    off = 0.12 ** np.abs(GRADES[:, None] - GRADES[None, :])
    np.fill_diagonal(off, 0)
    return off / off.sum(1, keepdims=True) * (1 - share) + share * np.eye(4)


SENTENCE_OF, LABEL_OF = near(OWN), near(READER)


def words_of(piece: str, kept: dict[str, tuple[tuple[str, ...], bool]] = {}) -> tuple[tuple[str, ...], bool]:  # noqa: B006 - kept between calls
    """The lower-case words of a piece of text between blanks, and whether it is a word and nothing else."""
    found = kept.get(piece)
    if found is None:
        if len(kept) >= KEPT:
            kept.clear()
        found = kept[piece] = (tuple(w.lower() for w in WORD.findall(piece)), WORDS.fullmatch(piece.strip(MARKS)) is not None)
    return found


def closed(text: str) -> bool:
    """Whether a text ends as a sentence does."""
    return text.rstrip(CLOSERS)[-1:] in (*ENDS, *FULL_ENDS) if text else False


def sentences(text: str | None) -> list[list[str]]:
    """The prose sentences of a text, each as its distinct lower-case words.

    Prose is a sentence that is closed, or a line with a bullet, of at least two words, most of whose tokens are words; in a text without
    either, a line of ``LINE_WORDS`` words or more, nearly all of whose tokens are words. Lines
    with columns (blanks in a row, tabs) are tables. Headings, placeholders, SQL, log and table pieces fall out, or hold words
    that tell nothing.
    """
    out, open_ = [], []
    for line in (text or "").splitlines():
        bare = line.strip()
        if not bare or "\t" in bare or "  " in bare and not closed(bare):
            continue
        bullet = BULLET.match(line)
        body = line[bullet.end() :] if bullet else bare
        wide = not body.isascii() and WIDE.search(body) is not None
        for part in (WIDE_END if wide else END).split(body):
            part = part.strip()
            if not part:
                continue
            pieces = [words_of(p) for p in (WIDE_PIECE.split(part) if wide else part.split()) if p]
            words, plain = sorted({w for p in pieces for w in p[0]}), sum(p[1] for p in pieces)
            count = sum(len(p[0]) for p in pieces if p[1])
            if bullet or closed(part):
                if count >= 2 and 2 * plain > len(pieces):
                    out.append(words)
            elif not out and count >= LINE_WORDS and plain >= LINE_SHARE * len(pieces):
                open_.append(words)
    return out or open_


def curves(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log odds of words by level: the c - k (l - b)^2 that comes nearest to the counted ones, weighed by what was counted.

    counts: words x 4, expected sentences of each level that hold the word; totals: words x 4, expected sentences of each level
    in the word's language.
    """
    share = (counts.sum(1, keepdims=True) + 1.0) / (totals.sum(1, keepdims=True) + 2.0)
    smooth = 2.0
    p = (counts + smooth * share) / (totals + smooth)
    p = np.minimum(p, 1 - 1e-6)
    logit = np.log(p) - np.log1p(-p)
    weight = (totals + smooth) * p * (1 - p)
    x = np.stack([np.ones(4), GRADES - 2.5, -((GRADES - 2.5) ** 2)], 1)
    gram = np.einsum("wl,li,lj->wij", weight, x, x) + np.diag([1e-6, 1e-3, 0.2])
    right = np.einsum("wl,li->wi", weight * logit, x)
    beta = np.linalg.solve(gram, right[:, :, None])[:, :, 0]
    flat = beta[:, 2] < 0  # no unfolding: a plain Rasch slope
    if flat.any():
        two = np.linalg.solve(gram[flat][:, :2, :2], right[flat][:, :2, None])[:, :, 0]
        beta[flat] = np.column_stack((two, np.zeros(len(two))))
    fitted = beta @ x.T
    return np.maximum(fitted, fitted.max(1, keepdims=True) - HOLD)


class Model:
    """Log chances by word, the words' languages, and each language's sum of chances by level.

    The likelihood of a sentence is the one given how many words it has, as usual for Rasch models: long sentences aren't hard by
    themselves. Given their number, a word is each one's in proportion to its chance.
    """

    def __init__(self, words: list[str], counts: np.ndarray, spoken: np.ndarray, totals: np.ndarray) -> None:
        """counts: words x 4; spoken: words x languages, sentences; totals: languages x 4, sentences."""
        self.place = {w: i for i, w in enumerate(words)}
        rate = (spoken + 0.01) / (totals.sum(1) + 1.0)
        own = rate / rate.sum(1, keepdims=True) if len(words) else rate
        chance = -np.log1p(np.exp(-curves(counts, own @ totals))) if len(words) else np.zeros((0, 4))  # log of the chance
        self.base = np.log(own.T @ np.exp(chance) + 1e-300) if len(words) else np.zeros((len(totals), 4))
        self.chance = np.vstack([chance, np.zeros(4)])
        self.speech = np.vstack([np.log(own), np.zeros(len(totals))]) if len(words) else np.zeros((1, len(totals)))
        self.sentences = spoken.sum(1)
        self.usual = totals.sum(0) / totals.sum()  # the share of each level, for texts of which no word is known

    def difficulty(self) -> pd.DataFrame:
        """Per word the level at which it is most likely."""
        return pd.DataFrame({"word": list(self.place), "level": 1 + self.chance[:-1].argmax(1), "reach": np.ptp(self.chance[:-1], axis=1)})

    def likelihoods(self, docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Likelihood of each sentence by level (scaled to a maximum of 1), and the document of each."""
        owner = np.array([d for d, doc in enumerate(docs) for _ in doc], np.int64)
        places = [[self.place.get(w, -1) for w in s] for doc in docs for s in doc]
        if not places:
            return np.zeros((0, 4)), owner
        flat = np.concatenate(places)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in places])[:-1]))
        known = np.add.reduceat((flat >= 0).astype(float), starts)
        language = np.add.reduceat(self.speech[flat], starts).argmax(1)
        log = np.add.reduceat(self.chance[flat], starts) - known[:, None] * self.base[language]
        return np.exp(log - log.max(1, keepdims=True)), owner

    def moved(self, other: Model | None) -> float:
        """The mean difference of the words' log chances, weighed by their sentences, from those of a model of the same words."""
        if other is None or self.chance.shape != other.chance.shape or not self.sentences.sum():
            return np.inf
        return float((np.abs(self.chance - other.chance)[:-1].mean(1) * self.sentences).sum() / self.sentences.sum())

    def levels(self, docs: list[list[list[str]]], prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of documents and of sentences by level, and the document of each sentence."""
        like, owner = self.likelihoods(docs)
        log = np.log(prior)
        if len(like):
            np.add.at(log, owner, np.log(like @ SENTENCE_OF.T + 1e-12))
        doc = np.exp(log - log.max(1, keepdims=True))
        doc /= doc.sum(1, keepdims=True)
        each = like * (doc[owner] @ SENTENCE_OF)
        return doc, each / np.maximum(each.sum(1, keepdims=True), 1e-300), owner


def labelled(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``prior, lang, sentences`` of a sample of the documents with readable labels; prior is what the readers say of the level,
    sentences are lines of words."""
    votes = labels.where(F.col("read_level").between(1, 4)).groupBy("doc_id").agg(*(F.count_if(F.col("read_level") == g).alias(f"v{g}") for g in range(1, 5)))
    n = votes.count()
    votes = votes.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(min(1.0, train_docs / max(n, 1)) * 1_000_000))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            log = f[["v1", "v2", "v3", "v4"]].to_numpy(float) @ np.log(LABEL_OF).T
            prior = np.exp(log - log.max(1, keepdims=True))
            yield pd.DataFrame({"prior": (prior / prior.sum(1, keepdims=True)).tolist(), "lang": f["lang"], "sentences": ["\n".join(map(" ".join, sentences(t))) for t in f["text"]]})

    own = docs.select("doc_id", "text", F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("")).alias("lang"))
    return votes.join(own, "doc_id").select("v1", "v2", "v3", "v4", "lang", "text").mapInPandas(run, "prior array<double>, lang string, sentences string").where("sentences <> ''")


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """The model by alternating optimisation, until the words settle.

    A round's counts are gathered by Spark. The words that reach the driver are those of a sample of ``train_docs`` documents
    that are in ``LEAST_SENTENCES`` sentences of it or more, which bounds the model that is then sent out.
    """
    sample = cut(labelled(docs, labels, train_docs))
    context = docs.sparkSession.sparkContext
    model = None
    for _ in range(rounds):
        held = context.broadcast(model)

        def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for f in frames:
                texts = [[line.split(" ") for line in doc.split("\n")] for doc in f["sentences"]]
                prior = np.array(f["prior"].tolist()).reshape(-1, 4)
                owner = np.array([d for d, doc in enumerate(texts) for _ in doc], np.int64)
                if not len(owner):
                    continue
                # at first each sentence has the level that the readers gave its document
                each = prior[owner] if held.value is None else held.value.levels(texts, prior)[1]
                flat = [s for doc in texts for s in doc]
                sentence = np.repeat(np.arange(len(flat)), [len(s) + 1 for s in flat])
                word, words = pd.factorize(np.array([w for s in flat for w in ("", *s)], object))  # the empty word counts sentences
                tongue, tongues = pd.factorize(f["lang"].to_numpy(object)[owner])
                key = tongue[sentence] * len(words) + word
                size = len(words) * len(tongues)
                sums = [np.bincount(key, each[sentence, k], size) for k in range(4)]
                n = np.bincount(key, minlength=size).astype(float)
                at = np.flatnonzero(n)
                yield pd.DataFrame({f"n{k + 1}": sums[k][at] for k in range(4)} | {"n": n[at], "word": words[at % len(words)], "lang": tongues[at // len(words)]})

        kinds = "n1 double, n2 double, n3 double, n4 double, n double, word string, lang string"
        counted = sample.mapInPandas(run, kinds).groupBy("word", "lang").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "n")))
        rows = counted.where(F.col("n") >= LEAST_SENTENCES).toPandas().sort_values(["word", "lang"], ignore_index=True)
        held.unpersist()
        model, last = of_counts(rows), model
        if model.moved(last) < SETTLED:
            break
    return model


def of_counts(rows: pd.DataFrame) -> Model:
    """The model of counts by word and language; languages with few of the sentences don't stand for themselves."""
    levels_ = ["n1", "n2", "n3", "n4"]
    every = rows[rows["word"] == ""].set_index("lang")
    languages = [g for g in every.index if g and every.loc[g, "n"] >= LEAST_LANGUAGE * every["n"].sum()] or [*every.index[:1]]
    if not languages:
        return Model([], np.zeros((0, 4)), np.zeros((0, 1)), np.ones((1, 4)))
    words = rows[rows["word"] != ""]
    counts = words.groupby("word")[levels_].sum()
    spoken = words.pivot_table(index="word", columns="lang", values="n", aggfunc="sum", fill_value=0.0).reindex(index=counts.index, columns=languages, fill_value=0.0)
    return Model(counts.index.tolist(), counts.to_numpy(), spoken.to_numpy(float), every.loc[languages, levels_].to_numpy(float))


def levels(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, read_level, certainty, n_sentences`` of every document with prose.

    Documents without prose (null, empty, blank, placeholders, tables) have no row. Repeated rows each have one. Labels that are null or outside
    1 to 4 are ignored, as are labels of unknown documents; several of one document are weighed together. Other columns are ignored. Without any
    label all levels are equally likely and the level is 1 with certainty 0.25. A text without any word of the model has the level of most
    sentences of the labelled documents, with certainty 0.25. Empty documents give an empty result.
    """
    model = fit(docs, labels, train_docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [sentences(t) for t in f["text"]]
            doc, _, _ = held.value.levels(texts, np.tile(0.25 + 1e-9 * (held.value.usual - 0.25), (len(texts), 1)))
            n = np.array([len(t) for t in texts], np.int64)
            out = pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), "read_level": (doc.argmax(1) + 1).astype(np.int32), "certainty": doc.max(1).round(6), "n_sentences": n})
            yield out[n > 0]

    return spread(docs.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, read_level int, certainty double, n_sentences bigint")
