"""Best-fit packing of documents into training sequences under several capacities.

A piece asks for three resources of a sequence: tokens, one document, and an attention cost of its
squared length. Pieces are dealt by hash into groups of bounded size; each group is packed on its
own, longest piece first. A piece goes to the open sequence that has room in every resource and
whose weighted residual is then smallest in norm (or whose residual has the largest weighted dot
product with the piece).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import bounded_batches, checkpointed, positive_hash

MAX_TOKENS = 4096
#: Neither binds for sequences of 4096 tokens: a piece has a token at least, and squared lengths
#: add up to 4096 squared at most.
MAX_DOCUMENTS = 4096
MAX_ATTENTION = MAX_TOKENS**2
WEIGHTS = (1.0, 0.02, 0.02)
END_ID = 1
#: Pieces that are packed together; more of them leave fewer half-filled sequences.
GROUP_PIECES = 16_384
#: Words whose ids a task remembers, none longer than so many characters.
CACHE_WORDS, CACHED_CHARS = 300_000, 40

#: Python splits at these four controls; the vocabulary's normaliser doesn't take them for spaces.
NOT_SPACE = re.compile("[\x1c-\x1f]")
WORD = re.compile(r"[\S\x1c-\x1f]+")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, WordIds] = {}


class WordIds(dict):
    """Little-endian ids of the words of a text, each word encoded once.

    White space is a boundary for this vocabulary's normaliser and pre-tokenizer, so a text's ids are
    those of its words in order. A word of letters, with or without marks after it, goes straight to
    the vocabulary's merges; all others take the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.bytes_to_chars = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?*$%&#|")
        plain = core.isascii() or (max(core) < "ɐ" and "İ" not in core)
        if core and plain and core.isalpha() and (core == word or not word.startswith("<|")):
            found = self.part(core.lower()) + (self.part(word[len(core) :]) if core != word else b"")
        else:
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) > CACHE_WORDS:
                self.clear()
            self[word] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.parts.clear()

    def part(self, text: str) -> bytes:
        if (found := self.parts.get(text)) is None:
            seen = text if text.isascii() else text.encode().decode("latin-1").translate(self.bytes_to_chars)
            found = np.array([t.id for t in self.merges.tokenize(seen)], "<u4").tobytes()
            if len(text) <= CACHED_CHARS:
                if len(self.parts) > CACHE_WORDS:
                    self.parts.clear()
                self.parts[text] = found
        return found

    def ids(self, text: str) -> bytes:
        words = text.split() if NOT_SPACE.search(text) is None else WORD.findall(text)
        return b"".join(map(self.__getitem__, words))


def word_ids(path: str) -> WordIds:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def cut_into_pieces(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The pieces of every document: its ids, then the end id, cut at ``max_tokens``.

    A null or empty text is the end id alone. Repeated rows are packed each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = word_ids(vocabulary).ids, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    cut = ids[at : at + 4 * max_tokens]
                    out.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        word_ids(vocabulary).forget()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each row of ``sizes``, rows in the order in which they are to be placed.

    rule "norm": smallest weighted norm of what would be left; "dot": largest weighted dot product of
    what is free with the item. Ties go to the oldest bin. Bins without room for the smallest later
    item leave the search.
    """
    need = sizes / capacity
    smallest = np.minimum.accumulate(need[::-1], axis=0)[::-1]
    free, label = np.empty((len(need), need.shape[1])), np.empty(len(need), np.int64)
    count = made = 0
    bins = np.empty(len(need), np.int64)
    for k, item in enumerate(need):
        if k % 256 == 0 and count:
            keep = np.flatnonzero((free[:count] >= smallest[k] - 1e-12).all(1))
            free[: len(keep)], label[: len(keep)], count = free[keep], label[keep], len(keep)
        left = free[:count] - item
        fits = (left >= -1e-12).all(1)
        if fits.any():
            value = ((weights * left) ** 2).sum(1) if rule == "norm" else -((weights * free[:count]) @ item)
            value[~fits] = np.inf
            at = int(value.argmin())
            free[at] = left[at]
        else:
            at, count = count, count + 1
            free[at], label[at], made = 1.0 - item, made, made + 1
        bins[k] = label[at]
    return bins


def pack(
    pieces: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_documents: int = MAX_DOCUMENTS,
    max_attention: int = MAX_ATTENTION,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``pieces`` (PIECES) with sequence_id and offset; every piece is placed, none twice.

    A piece that is over a capacity by itself gets a sequence of its own. Pieces are dealt by a hash
    of doc_id and piece; should repeated rows swell a group, it is dealt on by their number.
    """
    pieces = checkpointed(pieces.withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_pieces))
    capacity, weigh = np.array([max_tokens, max_documents, max_attention], float), np.array(weights)

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        length = rows["length"].to_numpy(np.float64)
        sizes = np.minimum(np.column_stack([length, np.ones(len(rows)), length**2]), capacity)
        rows["sequence_id"] = rows["group"] * (1 << 32) + best_fit(sizes, capacity, weigh, rule)
        rows["offset"] = rows.groupby("sequence_id", sort=False)["length"].cumsum() - rows["length"]
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return (
        pieces.withColumn("group", F.pmod(positive_hash("doc_id", "piece", "row"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, vocabulary: str, **limits: Any) -> DataFrame:
    """Tokenize, cut and pack whole documents; an empty table gives no rows."""
    return pack(cut_into_pieces(docs, vocabulary, limits.get("max_tokens", MAX_TOKENS)), **limits)
