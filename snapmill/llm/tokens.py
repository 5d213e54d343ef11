"""Sizes and ids of texts in tokens of a public tokenizer, whose folder and file are parameters."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FOLDER = os.environ.get("SNAPMILL_TOKENIZERS", "/opt/tokenizers")
FILE = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that this kind of byte-level vocabulary splits words by.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Texts are encoded in pieces that end at white space, so that one very long text needs no more memory than a long one.
PIECE = 1 << 16


@cache
def encoder(folder: str = FOLDER, file: str = FILE) -> Callable[[str], list[int]]:
    """Encodes a text to ids; loaded once per worker."""
    path = os.path.join(folder, file)
    if file.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if file.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return lambda text: own.encode(text, add_special_tokens=False).ids
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: model.encode(text, num_threads=1)


def pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE:
        cut = max(text.rfind(" ", start + PIECE // 2, start + PIECE), text.rfind("\n", start + PIECE // 2, start + PIECE))
        cut = cut if cut > start else start + PIECE
        yield text[start:cut]
        start = cut
    yield text[start:]


def ids(text: str | None, folder: str = FOLDER, file: str = FILE) -> list[int]:
    """The token ids of a whole text; none for a null or empty one."""
    if not text:
        return []
    encode = encoder(folder, file)
    return [i for piece in pieces(text) for i in encode(piece)]


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over as many tasks as run at once, if the table is so small that it is read in fewer; a larger one is left as it is
    read, so that only tables of some input splits are ever moved for this."""
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(tasks) if docs.rdd.getNumPartitions() < tasks else docs


def sized(docs: DataFrame, folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """``doc_id, source, n_tokens`` of ``docs`` (``doc_id, source, text``); a null or empty text has 0 tokens."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "n_tokens": np.array([len(ids(t, folder, file)) for t in f["text"]], np.int64)})

    return spread(docs.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")
