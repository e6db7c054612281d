"""Near copies by the Jaccard similarity of word n-gram sets, exact, with several global token orders.

A document's tokens are the hashes of its distinct n-grams. Documents with equal sets are one class.
Every order sorts frequent tokens last and the others by a hash of its own; two sets that are similar
enough share tokens among the first few of each order. Candidates share a token under the first
order, at positions that leave enough tokens after it; they must then share as many tokens as the
bound asks for under each further order. What is left is verified with whole sets.

A token's documents are first compared with one of them only; after that only pairs between different
components are verified, and for a token that many documents have no other pairs are formed at all.
Sets are compared by 64-bit hashes of their n-grams, whole sets by 128-bit digests; bytes are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.runtime import bounded_batches, checkpointed, kept_by, positive_hash, text_of

#: Tokens found in so many documents of one block are counted over all blocks; a block is so many tokens of a task.
LOCAL_COUNT, BLOCK_TOKENS = 2, 2_000_000
#: From this count on a token sorts behind the rare ones; at most so many tokens are told to the
#: tasks (9 MB). Tokens beyond sort with the rare ones, which costs time but no pair.
FREQUENT_COUNT, FREQUENT_TOKENS = 6, 1 << 20
#: A token that so many prefixes have, told to the tasks or not, is never paired off.
PAIRED_OFF = 16
#: Of each further order a prefix so many times as long is kept, of every token 16 bits.
FURTHER_PREFIXES = (1, 4)
#: Words whose hashes a task remembers.
CACHE_WORDS = 100_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xF1357AEA2E62A9C5], np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = xxh3_64_intdigest(word)
        return found


_word_hash = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; of fewer words the one of them all; of none, nothing.

    A-Z are lowered; words are split at the six ASCII spaces.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            total = _mix(total * _SEEDS[k % len(_SEEDS)] + h[k : len(h) - size + 1 + k])
    return np.unique(total)


def _measure(docs: DataFrame, words: int) -> DataFrame:
    """Per document its set's size and digest; per block (n = -1) the tokens that occur in several sets, packed."""

    def packed(block: dict[bytes, np.ndarray]) -> pd.DataFrame:
        token, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *block.values()]), return_counts=True)
        often = count >= LOCAL_COUNT
        return pd.DataFrame({"doc_id": [0], "n": [-1], "key": [token[often].tobytes() + count[often].astype(np.uint32).tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        block, held = {}, 0
        for batch in batches:
            sizes, keys = [], []
            for text in batch["text"]:
                s = shingles(text, words)
                sizes.append(len(s))
                keys.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s) and keys[-1] not in block:
                    block[keys[-1]] = s
                    held += len(s)
                    if held >= BLOCK_TOKENS:
                        yield packed(block)
                        block, held = {}, 0
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": sizes, "key": keys})
        if block:
            yield packed(block)
        _word_hash.clear()

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, key binary")


def _frequent(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens and their classes (the logarithm of the count); bounded."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch["key"]:
                size = len(packed) // 12
                yield pd.DataFrame({"token": np.frombuffer(packed, np.int64, size), "count": np.frombuffer(packed, np.uint32, size, 8 * size).astype(np.int64)})

    counted = measured.where("n < 0").select("key").mapInPandas(unpack, "token long, count long")
    top = (
        counted.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= FREQUENT_COUNT)
        .orderBy(F.desc("count"), "token").limit(FREQUENT_TOKENS).toPandas()
    )
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.log2(top["count"].to_numpy(np.float64)[order]).astype(np.uint8)


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - (n * percent + 99) // 100 + 1


def _prefixes(docs: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """node, n, cold (rare tokens in the first prefix), first and further prefixes."""
    told = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, classes = told.value
        for batch in batches:
            out = []
            for node, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text, words)
                if not len(s):
                    continue
                p, rank = prefix_length(len(s), percent), np.zeros(len(s), np.uint64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    rank = np.where(tokens[at] == s, classes[at].astype(np.uint64), rank)
                found = []
                for k, times in enumerate((1, *FURTHER_PREFIXES)):
                    size = min(len(s), p * times)
                    key = (rank << np.uint64(58)) | (_mix(s + _SEEDS[k]) >> np.uint64(6))
                    first = np.argpartition(key, size - 1)[:size] if size < len(s) else np.arange(len(s))
                    if k == 0:
                        first = first[np.argsort(key[first])]
                        cold = int((rank[first] == 0).sum())
                        found.append(s[first].view(np.int64))
                    else:
                        found.append(np.unique(s[first].astype(np.uint16)).view(np.int16))
                out.append((node, len(s), cold, *found))
            yield pd.DataFrame(out, columns=["node", "n", "cold", "first", *(f"further{k}" for k in range(len(FURTHER_PREFIXES)))])
        _word_hash.clear()

    kinds = ", ".join(f"further{k} array<short>" for k in range(len(FURTHER_PREFIXES)))
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, f"node long, n long, cold long, first array<long>, {kinds}")


def _enough_left(percent: int) -> Column:
    """From the shared token on, both sets still have the tokens that the similarity asks for."""
    left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return left * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent


def _unpacked(place: str) -> dict[str, Column]:
    """Set size and position, which share a long while they cross the network."""
    return {"n": F.shiftright(place, 31), "pos": F.col(place).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")}


def _pairs(joined: DataFrame) -> DataFrame:
    a, b = F.col("a.node"), F.col("b.node")
    return joined.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x < y")


def _further_orders(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs that share enough tokens under every further order, one order after the other.

    If two sets are similar enough, their first ``bound`` common tokens are in both prefixes. Tokens are
    compared by 16 bits; a set's prefix that has fewer distinct ones than tokens lowers the bound. Only
    prefixes of some pair are moved.
    """
    for k, times in enumerate(FURTHER_PREFIXES):
        nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        wanted = kept_by(prefixes.select("node", "n", f"further{k}"), nodes, 2 * pairs.count(), positive_hash("node"), positive_hash("node")).where("maybe")
        length = F.least("n", F.lit(times) * (F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1))
        side = lambda at: wanted.select(F.col("node").alias(at), F.col("n").alias(f"{at}_n"), length.alias(f"{at}_length"), F.col(f"further{k}").alias(f"{at}_tokens"))  # noqa: B023, E731
        both = pairs.join(side("x"), "x").join(side("y"), "y")
        needed = F.expr(f"((x_n + y_n) * {percent} + {99 + percent}) div {100 + percent}")
        bound = F.least(*[F.col(f"{s}_length") - (F.col(f"{s}_n") - needed) for s in "xy"])
        lost = F.col("x_length") - F.size("x_tokens")
        pairs = checkpointed(both.where(F.size(F.array_intersect("x_tokens", "y_tokens")) >= bound - lost).select("x", "y").distinct())
    return pairs


def _verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar enough; only documents of some pair leave the scan."""
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    wanted = kept_by(docs.select("doc_id", "text"), nodes, 2 * pairs.count(), positive_hash("doc_id"), positive_hash("doc_id"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["doc_id"], "tokens": [shingles(t, words).tobytes() for t in batch["text"]]})
        _word_hash.clear()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for left, right in zip(batch["left"], batch["right"], strict=True):
                a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield batch.loc[keep, ["x", "y"]]

    sets = wanted.where("maybe").select("doc_id", "text").mapInPandas(measure, "node long, tokens binary")
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("tokens").alias("left")), "x")
    both = both.join(sets.select(F.col("node").alias("y"), F.col("tokens").alias("right")), "y")
    return both.mapInPandas(compare, "x long, y long").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, label of every linked node, the label being the smallest node that it reaches.

    Large-star and small-star steps by turns, until the links are stars; each step is written to the
    shared folder. Hubs are handled by partial minima and by joins that Spark can split.
    """
    links = checkpointed(links.select("x", "y").where("x <> y").distinct())
    while True:
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        down = large.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(least, "x").select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("y").alias("x"), "m"))).alias("e"))
        found = checkpointed(small.select(F.greatest("e.x", "e.m").alias("x"), F.least("e.x", "e.m").alias("y")).where("x <> y").distinct())
        same = found.count() == links.count() and found.join(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")), ["x", "y"], "left_anti").isEmpty()
        links = found
        if same:
            break
    return links.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(
        links.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct()
    )


def _links(docs: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], known: DataFrame | None = None) -> DataFrame:
    """node, label of the linked ones among ``docs``; ``known`` (x, y) are links that need no search."""
    prefixes = checkpointed(_prefixes(docs, words, percent, frequent))
    tokens = prefixes.select("node", "n", "cold", F.posexplode("first").alias("pos", "token"))
    told = tokens.where("pos >= cold")
    packed = tokens.where("pos < cold").select("token", "node", "cold", F.shiftleft("n", 31).bitwiseOR(F.col("pos")).alias("place"))
    own = Window.partitionBy("token")
    after = own.orderBy("node").rowsBetween(1, PAIRED_OFF - 1)
    shared = packed.withColumn("has", F.count("*").over(own)).withColumn("after", F.collect_list(F.struct("node", "place")).over(after)).withColumn("rank", F.row_number().over(own.orderBy("node")))
    few = F.col("has") <= PAIRED_OFF
    shared = checkpointed(shared.where("has > 1").withColumn("after", F.when(few, F.col("after"))).withColumns(_unpacked("place")).drop("place"))
    hot = checkpointed(told.unionByName(shared.where(~few).select(*told.columns)))
    rare = shared.where(few).select("node", "n", "pos", (F.col("rank") == 1).alias("first"), F.explode("after").alias("b"))
    rare = rare.select(F.struct("node", "n", "pos").alias("a"), F.struct("b.node", *[c.alias(name) for name, c in _unpacked("b.place").items()]).alias("b"), "first").where(_enough_left(percent) & (F.col("a.node") < F.col("b.node")))
    rare = checkpointed(rare.groupBy(F.col("a.node").alias("x"), F.col("b.node").alias("y")).agg(F.bool_or("first").alias("first")))
    # The document with the fewest rare tokens is the likeliest to be close to the others.
    centre = hot.groupBy("token").agg(F.min(F.struct("cold", "node", "n", "pos")).alias("c")).select("token", "c.*")
    other = F.col("a.node") != F.col("b.node")
    starred = _pairs(hot.alias("a").join(centre.alias("b"), (F.col("a.token") == F.col("b.token")) & other & _enough_left(percent)))

    def verified(pairs: DataFrame) -> DataFrame:
        likely = _further_orders(checkpointed(pairs.distinct()), prefixes, percent)
        return checkpointed(_verify(likely, docs, words, percent))

    found = verified(rare.where("first").select("x", "y").unionByName(starred))
    found = found if known is None else found.unionByName(known)
    labels = connected_components(found)
    grouped = hot.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = grouped.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    rest = checkpointed(grouped.join(mixed, "token").select("token", "node", "n", "pos", "label"))
    across = (F.col("a.token") == F.col("b.token")) & (F.col("a.label") < F.col("b.label")) & _enough_left(percent)
    later = rare.where("NOT first").select("x", "y")
    for end in "xy":
        later = later.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    later = later.where(F.coalesce("label_x", "x") != F.coalesce("label_y", "y")).select("x", "y")
    more = verified(_pairs(rest.alias("a").join(rest.alias("b"), across)).unionByName(later))
    return labels if more.isEmpty() else connected_components(found.unionByName(more))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link when 100 * shared >= percent * united n-grams. Null and wordless texts have no
    n-gram and link with nothing. A row without identifier links with nothing and has none as its
    component. Repeated rows share a component; an identifier with several texts is one document with the
    links of each, so what those texts link shares a component too.
    An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    measured = checkpointed(_measure(known, words))
    rows = measured.where("n >= 0").select("doc_id", "n", "key")
    frequent = _frequent(measured)
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    several = checkpointed(classes.where("copies > 1").select("key", "node"))
    mapped = checkpointed(rows.join(several, "key", "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")))

    # An identifier that stands for a set itself stays in the search with all its texts: they are one document.
    # One that only copies several other documents links those.
    key = positive_hash("doc_id")
    moved = checkpointed(mapped.where("node <> doc_id").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")))
    own = kept_by(mapped.where("node = doc_id").select("doc_id"), moved, moved.count(), key, key).where("maybe").select("doc_id").distinct()
    copies = checkpointed(moved.join(own, "doc_id", "left_anti"))
    between, torn = None, copies.where("low <> high").select("doc_id", F.col("low").alias("x"))
    if not torn.isEmpty():
        between = checkpointed(torn.join(mapped, "doc_id").select("x", F.col("node").alias("y")).where("x <> y").distinct())
    copies = copies.select("doc_id")
    size = copies.count()
    spared = checkpointed(kept_by(known.select("doc_id"), copies, size, key, key).where("maybe").select("doc_id").distinct().join(copies, "doc_id", "left_anti"))
    single = kept_by(known, copies, size, key, key).withColumnRenamed("maybe", "copy")
    single = kept_by(single, spared, spared.count(), key, key).where("NOT copy OR maybe")  # a copy that slips through joins its own group
    labels = _links(single.select("doc_id", "text"), words, percent, frequent, between)

    out = mapped.join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component_id"))
    if (nameless := docs.where("doc_id IS NULL")).isEmpty():
        return out
    return out.unionByName(_measure(nameless, words).where("n >= 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were: of each component the smallest doc_id.

    Rows without identifier stay; all rows of an identifier that goes, go.
    """
    dropped = checkpointed(near_groups(docs, words, percent).where("component_id <> doc_id").select("doc_id").distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    probed = kept_by(rows, dropped, dropped.count(), positive_hash("doc_id"), positive_hash("doc_id"))
    alone = probed.where("not maybe").select("row.*")
    return alone.unionByName(probed.where("maybe").join(dropped, "doc_id", "left_anti").select("row.*"))
