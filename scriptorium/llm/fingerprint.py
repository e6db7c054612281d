"""Threshold-scaled sketches: every word-shingle hash below a fixed fraction of the hash range.

A sketch holds the 63-bit hashes of a document's distinct five-word shingles that are below the
threshold. Documents with few such hashes keep their smallest FLOOR ones, and the sketch says up to
which value it is whole. Two sketches compare below the smaller of their limits, so likeness and
containment are unbiased between very unequal documents, and sketches of parts merge by union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.runtime import few_rows, place_among, positive_hash, quantiles, text_of

WORDS = 5
#: One hash in eight is kept.
SCALE = 8
FLOOR = 32
TOP = (1 << 63) - 1
#: Rows that are sorted together to find each one's next document, and the bound of such ranges.
RANGE_ROWS, MAX_RANGES = 256, 8192
#: Expected samples a range.
SAMPLES_PER_RANGE = 16
#: Where a null identifier stands.
LOWEST = -(1 << 63)


def with_sketch(rows: DataFrame, text: str, prefix: str, words: int = WORDS, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """``rows`` with ``{prefix}_limit`` and ``{prefix}_hashes`` (sorted); a null text has an empty sketch.

    Shingles are the word n-grams of the lowered text; of fewer words the one of them all.
    """
    limit = TOP // scale
    word, every, low = f"{prefix}_word", f"{prefix}_every", f"{prefix}_hashes"
    found = F.filter(F.split(F.lower(text_of(text)), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    rows = rows.withColumn(word, F.transform(found, lambda w: F.xxhash64(w)))
    starts = F.when(F.size(word) > 0, F.sequence(F.lit(0), F.greatest(F.size(word) - words, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(every, F.transform(starts, lambda i: F.xxhash64(F.slice(word, i + 1, words)).bitwiseAND(F.lit(TOP))))
    rows = rows.withColumn(low, F.array_sort(F.array_distinct(F.filter(every, lambda h: h <= limit))))
    enough = F.size(low) >= floor
    rows = rows.withColumn(f"{prefix}_kept", F.when(enough, F.col(low)).otherwise(F.slice(F.array_sort(F.array_distinct(every)), 1, floor)))
    kept = F.col(f"{prefix}_kept")
    bound = F.when(enough, F.lit(limit)).when(F.size(kept) < floor, F.lit(TOP)).otherwise(F.greatest(F.array_max(kept), F.lit(limit)))
    return rows.withColumn(f"{prefix}_limit", bound).drop(word, every, low).withColumnRenamed(f"{prefix}_kept", low)


def merged(a: str, b: str) -> tuple[Column, Column]:
    """Limit and hashes of the union of two sketched documents."""
    limit = F.least(f"{a}_limit", f"{b}_limit")
    return limit, F.array_sort(F.filter(F.array_union(f"{a}_hashes", f"{b}_hashes"), lambda h: h <= limit))


def _below(a: str, b: str) -> tuple[Column, Column]:
    limit = F.least(f"{a}_limit", f"{b}_limit")
    return tuple(F.filter(f"{s}_hashes", lambda h: h <= limit) for s in (a, b))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity; 1 of two empty sketches."""
    left, right = _below(a, b)
    both = F.size(F.array_intersect(left, right))
    united = F.size(left) + F.size(right) - both
    return F.when(united == 0, 1.0).otherwise(both / united)


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has; 1 of an empty a."""
    left, right = _below(a, b)
    return F.when(F.size(left) == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / F.size(left))


def rendered(prefix: str) -> Column:
    """The fingerprint as text: limit, then the hashes, in hexadecimal."""
    return F.concat_ws(":", F.hex(f"{prefix}_limit"), F.concat_ws(",", F.transform(f"{prefix}_hashes", lambda h: F.hex(h))))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) sketched, with ``next_*`` of the next row, descending doc_id, then cyclic.

    Sampled splitters part the rows into ranges of identifiers, and of text hashes where one identifier
    has very many rows. A row crosses the network once, to its range. The first row of the next lower
    range, needed by a range's last row, joins it as a guest; there is one guest a range.
    """
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("place"), positive_hash("text").alias("tie"))
    count = docs.count()
    ranges = max(1, min(MAX_RANGES, count // RANGE_ROWS))
    drawn = rows.where(F.rand(5) < F.lit(SAMPLES_PER_RANGE * ranges / max(count, 1)))
    sample = sorted((r["place"], r["tie"]) for r in drawn.select("place", "tie").collect())
    rows = rows.withColumn("range", place_among(sorted(set(quantiles(sample, ranges))), F.col("place"), F.col("tie")))

    heads = [tuple(r) for r in rows.groupBy("range").agg(F.max(F.struct("place", "tie")).alias("head")).select("range", "head.*").orderBy("range").collect()]
    needed = [(upper[0], *lower[1:]) for lower, upper in zip([heads[-1], *heads[:-1]] if heads else [], heads, strict=True)]
    guests = few_rows(docs.sparkSession, needed, "host int, place long, tie long")
    guests = rows.drop("range").join(F.broadcast(guests), ["place", "tie"]).groupBy(F.col("host").alias("range"), "place", "tie").agg(F.max("text").alias("text"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", "place", "tie", "range")

    rows = with_sketch(rows, "text", "own").withColumn("guest", F.lit(0)).unionByName(with_sketch(guests, "text", "own").withColumn("guest", F.lit(1)))
    order = Window.partitionBy("range").orderBy("guest", F.desc("place"), F.desc("tie"), F.desc("text"))
    following = F.lead(F.struct("text", "own_limit", "own_hashes")).over(order)
    return rows.withColumn("next", following).where("guest = 0").select("doc_id", "text", "own_limit", "own_hashes", *[F.col(f"next.{c}").alias(f"next_{c}") for c in ("text", "own_limit", "own_hashes")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs`` with the fingerprints of its text and of an edited text.

    The edited text has its last third of code points replaced by the first as many of the next
    document. Null texts count as empty: they have an empty sketch and equal other empty ones. Rows
    that share an identifier are ordered by a hash of their text, descending; rows without identifier
    come last. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = with_next(rows)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    rows = with_sketch(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited")
    rows = rows.withColumnsRenamed({"next_own_limit": "next_limit", "next_own_hashes": "next_hashes"})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", rendered("own").alias("fingerprint"), rendered("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"),
        containment("own", "edited").alias("contained_in_edited"),
    )
