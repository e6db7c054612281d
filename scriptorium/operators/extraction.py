"""Gates that decide whether a file's text is usable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.vocabulary import MAX_FILE_BYTES, MIN_TEXT_CHARS


def space_share(text: Column) -> Column:
    """Share of characters that are spaces; 1 of an empty text."""
    size = F.char_length(text)
    return F.when(size == 0, 1.0).otherwise((size - F.char_length(F.replace(text, F.lit(" "), F.lit("")))) / size)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def fragment_share(text: Column) -> Column:
    """Share of tokens of one character; 1 without tokens."""
    found = tokens(text)
    return F.when(F.size(found) == 0, 1.0).otherwise(F.size(F.filter(found, lambda w: F.char_length(w) == 1)) / F.size(found))


def best_reading(readings: Column) -> Column:
    """Of alternative readings of a page the first unless its words run together and a later one is clean."""
    first = F.get(readings, F.lit(0))
    clean = F.filter(readings, lambda r: (space_share(r) >= 0.08) & (fragment_share(r) <= 0.12))
    return F.when(space_share(first) >= 0.04, first).otherwise(F.coalesce(F.get(clean, F.lit(0)), first))


def extract_gate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ok, error, char_count and the two shares. A null text is an empty one."""
    value = F.coalesce(F.col(text), F.lit(""))
    size = F.char_length(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return docs.select(
        "*", (size >= MIN_TEXT_CHARS).alias("ok"), F.when(size < MIN_TEXT_CHARS, "too_little_text").alias("error"),
        F.char_length(value).cast("long").alias("char_count"), F.round(space_share(value), 6).alias("space_share"), F.round(fragment_share(value), 6).alias("fragment_share"),
    )


def file_gate(files: DataFrame) -> DataFrame:
    """``files`` (path, length) with the error of files that are too large or of an unknown kind."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    error = F.when(F.col("length") > MAX_FILE_BYTES, "too_large").when(~kind.isin("pdf", "docx", "txt", "md"), "unsupported")
    return files.withColumn("kind", kind).withColumn("error", error)


def word_gate(rows: DataFrame, flat: str, structural: str, share: float = 0.9) -> DataFrame:
    """The structural reading where it keeps enough of the flat reading's words, else the flat one."""
    keeps = F.size(tokens(F.coalesce(F.col(structural), F.lit("")))) >= share * F.size(tokens(F.coalesce(F.col(flat), F.lit(""))))
    return rows.withColumn("reading", F.when(keeps, F.col(structural)).otherwise(F.col(flat)))


def arbitrated(flat: DataFrame, structural: DataFrame, share: float = 0.9) -> DataFrame:
    """doc_id, reading, reader, share, flat_words, words, note of documents read twice (doc_id, text in both).

    The structural reading is kept if it has at least ``share`` of the flat one's words; a document that it
    lacks, or where it lost more, keeps the flat reading and a note. A null text has no words.
    """
    words = lambda c: F.size(tokens(F.coalesce(F.col(c), F.lit("")))).cast("long")
    rows = flat.select("doc_id", F.col("text").alias("flat")).join(structural.select("doc_id", F.col("text").alias("made")), "doc_id", "left")
    rows = rows.withColumns({"flat_words": words("flat"), "words": words("made")})
    missing = F.col("made").isNull()
    keeps = ~missing & (F.col("words") >= share * F.col("flat_words"))
    note = F.when(missing, "no structural reading").when(~keeps, F.concat(F.lit("the structural reading has "), F.col("words"), F.lit(" words of "), F.col("flat_words")))
    part = F.when(F.col("flat_words") > 0, F.round(F.col("words") / F.col("flat_words"), 6))
    return rows.select("doc_id", F.when(keeps, F.col("made")).otherwise(F.col("flat")).alias("reading"), F.when(keeps, "tree").otherwise("flat").alias("reader"), part.alias("share"), "flat_words", "words", note.alias("note"))
