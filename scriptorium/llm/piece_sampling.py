"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and their decoding.

A piece can only run over a place in the text if its two neighbouring characters are neighbours in some
piece. Everywhere else the lattice falls apart exactly, so a text is a sequence of independent units
(words with the space before them, mostly), whatever their length; no piece of the vocabulary is left
out. A unit's forward sums are computed once and kept for a while. Sampling walks the units of a batch
backwards together: a step picks, for every unit not yet at its start, the piece that ends where the
unit stands, in proportion to the forward sums. Random numbers are a hash of seed, row key and place in
the text, so a row's segmentation depends on nothing else.

The public vocabulary is a merge list whose scores are ranks, not probabilities; a piece's weight is
(rank + OFFSET) ** -alpha, and a byte is weighed as the last piece. Characters outside the vocabulary,
and the space mark where a text has it itself, are written as bytes, so decoding gives the same text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import bounded_batches

ALPHA, OFFSET, SEED = 0.5, 3.0, 1
MARK = "▁"
#: Bounds of the kept tables: edges (13 bytes each) and units. Beyond them the tables start anew.
MAX_EDGES, MAX_UNITS = 8_000_000, 350_000
#: Characters that are sampled together, and those whose tables are computed together.
BATCH_CHARS, LEARN_CHARS = 300_000, 150_000
_lattices: dict[tuple[str, float], Lattices] = {}


class _Table:
    """An array that grows by halves."""

    def __init__(self, kind: type) -> None:
        self.array, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.array):
            grown = np.zeros(max(need, len(self.array) * 3 // 2), self.array.dtype)
            grown[: self.size] = self.array[: self.size]
            self.array = grown
        self.array[self.size : need] = values
        self.size = need


class Lattices:
    """Forward tables of units, laid end to end: node (unit, place) has a run of incoming edges."""

    def __init__(self, path: str, alpha: float) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_first = next(i for i in range(size) if model.is_byte(i))
        kept = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.automaton = ahocorasick.Automaton()
        self.log_weight, self.chars = np.zeros(size), np.ones(size, np.int64)
        self.spelt = [b""] * size
        self.single = np.full(0x110000, -1, np.int32)  # pieces of one character
        neighbours = set()
        for rank, i in enumerate(kept):
            piece = model.id_to_piece(i)
            if len(piece) == 1:
                self.single[ord(piece)] = i
            else:
                self.automaton.add_word(piece, i)
                neighbours.update(zip(piece, piece[1:], strict=False))
            self.log_weight[i], self.chars[i] = -alpha * np.log(rank + OFFSET), len(piece)
            self.spelt[i] = piece.replace(MARK, " ").encode()
        self.automaton.make_automaton()
        self.log_byte = -alpha * np.log(len(kept) + OFFSET)
        for b in range(256):
            self.spelt[self.bytes_first + b] = bytes([b])
        known = sorted({c for pair in neighbours for c in pair})
        number = {c: k + 1 for k, c in enumerate(known)}
        self.kind = np.zeros(0x110000, np.uint16)  # 0: no neighbour in any piece
        for c, k in number.items():
            self.kind[ord(" " if c == MARK else c)] = k
        self.kind[ord(MARK)] = 0
        self.glued = np.zeros((len(known) + 1, len(known) + 1), bool)
        for a, b in neighbours:
            self.glued[number[a], number[b]] = True
        self.reset()

    def reset(self) -> None:
        self.units: dict[str, int] = {}
        self.length, self.first, self.start = _Table(np.int32), _Table(np.int64), _Table(np.int64)
        self.cdf, self.back, self.edge = _Table(np.float64), _Table(np.uint8), _Table(np.int32)
        self.codes: list[list[int]] = []

    def cuts(self, text: str) -> np.ndarray:
        """Where units begin, and the end of the text; no piece runs over these places."""
        kind = self.kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return np.concatenate([[0], np.flatnonzero(~self.glued[kind[:-1], kind[1:]]) + 1, [len(text)]])

    def learn(self, units: list[str]) -> None:
        """Add the tables of new units, all places of the same depth at once.

        Units are matched in one string, a line each; the space mark of a text and any character
        outside the vocabulary can only be bytes.
        """
        lines = [u.replace(MARK, "\n").replace(" ", MARK) for u in units]
        length = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(length + 1) - (length + 1)
        depth = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        node_at = np.full(int((length + 1).sum()), -1, np.int64)
        node_at[np.repeat(begin, length) + depth] = np.arange(len(depth))
        joined = "\n".join(lines)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        single = self.single[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)][node_at[: len(joined)] >= 0]
        every = "".join(units)
        own_break = np.frombuffer(every.encode("utf-32-le", "surrogatepass"), np.uint32)
        single = np.where(own_break == ord("\n"), self.single[ord("\n")], np.where(own_break == ord(MARK), -1, single))
        alone, missing = np.flatnonzero(single >= 0), np.flatnonzero(single < 0)
        node, piece = np.concatenate([node_at[found[:, 0]], alone]), np.concatenate([found[:, 1], single[alone]])
        back = self.chars[piece]
        raw = [every[k].encode("utf-8", "surrogatepass") for k in missing.tolist()]
        codes = []
        for spelt in raw:
            codes.append(self.bytes_first + spelt[0] if len(spelt) == 1 else -1 - len(self.codes))
            if len(spelt) > 1:
                self.codes.append([self.bytes_first + b for b in spelt])
        weight = np.concatenate([self.log_weight[piece], self.log_byte * np.array([len(r) for r in raw], float)])
        node, back, piece = np.concatenate([node, missing]), np.concatenate([back, np.ones(len(missing), np.int64)]), np.concatenate([piece, np.array(codes, np.int64)])
        order = np.argsort((depth[node] * len(depth) + node) * 32 + back)  # no ties, so that sums never depend on the other units
        node, back, piece, weight = node[order], back[order], piece[order], weight[order]
        forward = np.zeros(len(depth))
        value = np.empty(len(node))
        level = depth[node]
        cuts = np.flatnonzero(np.diff(level, prepend=-1))
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(level)], strict=True):
            n, s = node[low:high], back[low:high]
            before = np.where(s > level[low], 0.0, forward[n - s]) + weight[low:high]
            heads = np.flatnonzero(np.diff(n, prepend=-1))
            runs = np.diff(heads, append=len(n))
            top = np.maximum.reduceat(before, heads)
            share = np.exp(before - np.repeat(top, runs))
            total = np.add.reduceat(share, heads)
            forward[n[heads]] = top + np.log(total)
            value[low:high] = share / np.repeat(total, runs)
        likely = (value * 2.0**29).astype(np.int64)
        order = np.argsort((node << 35) - (likely << 5) + back)  # a node's likeliest edge first
        node, value = node[order], value[order]
        heads = np.flatnonzero(np.diff(node, prepend=-1))
        ends = np.append(heads[1:], len(node))
        at = heads + 1
        while len(at):
            at, ends = at[at < ends], ends[at < ends]
            value[at] += value[at - 1]
            at = at + 1
        value[np.append(heads[1:], len(node)) - 1] = 1.0
        self.units.update(zip(units, range(self.length.size, self.length.size + len(units)), strict=True))
        self.first.extend(self.start.size + np.cumsum(length) - length)
        self.length.extend(length)
        self.start.extend(self.cdf.size + heads)
        self.cdf.extend(value)
        self.back.extend(back[order])
        self.edge.extend(piece[order])

    def numbers(self, said: list[str]) -> np.ndarray:
        """The tables' numbers of units, unknown ones learnt a bounded part at a time."""
        found = list(map(self.units.get, said))
        if None not in found:
            return np.array(found, np.int64)
        if self.cdf.size > MAX_EDGES or len(self.units) > MAX_UNITS:
            self.reset()
            found = [None] * len(said)
        new = list({u for u, n in zip(said, found, strict=True) if n is None})
        begin, chars = 0, 0
        for k, unit in enumerate(new, 1):
            chars += len(unit)
            if chars >= LEARN_CHARS or k == len(new):
                self.learn(new[begin:k])
                begin, chars = k, 0
        return np.fromiter(map(self.units.__getitem__, said), np.int64, len(said))


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattices(path, alpha)
    return _lattices[path, alpha]


def _uniform(key: np.ndarray, step: int, seed: int) -> np.ndarray:
    """Hashed numbers in [0, 1) of a unit's key and the step."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((step * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        return (x >> np.uint64(11)) * 2.0**-53


def _blocks(texts: list[str], made: Lattices) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (row, place, part of its text) of about BATCH_CHARS; long texts are parted between units."""
    block, chars = [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            window = BATCH_CHARS - chars
            while True:
                stop = min(len(text), at + window)
                if stop == len(text):
                    break
                cuts = made.cuts(text[at : stop + 1])
                if (inner := cuts[(cuts > 0) & (cuts <= stop - at)]).size:
                    stop = at + int(inner[-1])
                    break
                window *= 2
            block.append((row, at, text[at:stop]))
            chars += stop - at
            at = stop
            if chars >= BATCH_CHARS or at < len(text):
                yield block
                block, chars = [], 0
    if block:
        yield block


def _draw(block: list[tuple[int, int, str]], keys: np.ndarray, made: Lattices, seed: int) -> list[np.ndarray]:
    """Ids of one sampled segmentation of each part."""
    said, counts, key = [], [], []
    for row, at, text in block:
        cuts = made.cuts(text)
        bounds = cuts.tolist()
        said += [text[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        counts.append(len(bounds) - 1)
        with np.errstate(over="ignore"):
            key.append(keys[row] + (cuts[:-1] + at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    unit, key = made.numbers(said), np.concatenate(key)
    start, cdf, back, edge = made.start.array, made.cdf.array, made.back.array, made.edge.array
    total = len(unit)
    base, at, live = made.first.array[unit] - 1, made.length.array[unit].astype(np.int64), np.arange(total)
    order, picked, step = [], [], 0
    while len(live):
        chosen = start[base[live] + at[live]]
        drawn = _uniform(key[live], step, seed)
        beyond = np.flatnonzero(cdf[chosen] <= drawn)
        while len(beyond):
            chosen[beyond] += 1
            beyond = beyond[cdf[chosen[beyond]] <= drawn[beyond]]
        order.append(live)
        picked.append(edge[chosen])
        at[live] -= back[chosen]
        live = live[at[live] > 0]
        step += 1
    who = np.concatenate(order)
    depth = np.repeat(np.arange(len(order)), [len(o) for o in order])
    steps = np.bincount(who, minlength=total)
    begin = np.cumsum(steps) - steps
    ids = np.empty(len(who), np.int32)
    ids[begin[who] + steps[who] - 1 - depth] = np.concatenate(picked)
    part = np.repeat(np.repeat(np.arange(len(block)), counts), steps)
    if (spelt := np.flatnonzero(ids < 0)).size:
        size = np.ones(len(ids), np.int64)
        size[spelt] = [len(made.codes[-1 - i]) for i in ids[spelt].tolist()]
        whole = np.repeat(ids, size)
        whole[whole < 0] = [b for i in ids[spelt].tolist() for b in made.codes[-1 - i]]
        ids, part = whole, np.repeat(part, size)
    ends = np.cumsum(np.bincount(part, minlength=len(block)))
    return np.split(ids, ends[:-1])


def sample(texts: list[str], keys: np.ndarray, made: Lattices, seed: int = SEED) -> list[np.ndarray]:
    """Ids of one sampled segmentation a text; beside them memory holds one block and its longest unit."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    keys = keys.astype(np.int64).view(np.uint64)
    for block in _blocks(texts, made):
        for (row, _, _), ids in zip(block, _draw(block, keys, made, seed), strict=True):
            out[row].append(ids)
    return [parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in out]


def decode(ids: np.ndarray, made: Lattices) -> str:
    return b"".join(map(made.spelt.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


def encode_sampled(docs: DataFrame, model: str, seed: int = SEED, alpha: float = ALPHA, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``ids`` added: a sampled segmentation of the whole text, seeded by the row's key.

    A null or empty text has no ids. Equal texts under different keys are segmented differently, equal
    rows alike; a null key counts as -1. A column named ids is replaced. No row is moved.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(keys: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(sample([t or "" for t in texts], keys.to_numpy(np.int64), lattices(model, alpha), seed), dtype=object)

    return docs.withColumn("ids", run(F.coalesce(F.col(key).cast("long"), F.lit(-1)), F.col("text")))


def encode_and_decode(docs: DataFrame, model: str, seed: int = SEED, alpha: float = ALPHA, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``ids`` as ``encode_sampled`` adds them and ``decoded``, the text that they give again.

    One function does both: of a decoder chained to an encoder, Spark would run the encoder twice.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("ids array<int>, decoded string")
    def run(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        made = lattices(model, alpha)
        ids = sample([t or "" for t in texts], keys.to_numpy(np.int64), made, seed)
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([decode(i, made) for i in ids], dtype=object)})

    both = docs.withColumn("ids", run(F.coalesce(F.col(key).cast("long"), F.lit(-1)), F.col("text")))
    return both.withColumn("decoded", F.col("ids.decoded")).withColumn("ids", F.col("ids.ids"))


def decode_ids(rows: DataFrame, model: str, alpha: float = ALPHA) -> DataFrame:
    """``rows`` with ``decoded`` added, the text of ``ids``."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        made = lattices(model, alpha)
        return pd.Series([decode(np.asarray(i), made) for i in ids], dtype=object)

    return rows.withColumn("decoded", run("ids"))
