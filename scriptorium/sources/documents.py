"""Files as rows: pasted text, Word documents and, through a hook, anything else."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.vocabulary import MAX_FILE_BYTES

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> tuple[str, int, str | None]:
    """Text, number of tables and error: paragraphs, list items behind a hyphen, then table cells."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return "", 0, "unreadable"
    if body is None:
        return "", 0, None
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t"))
    lines = []
    for paragraph in body.findall(f"{_W}p"):
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        listed = paragraph.find(f"{_W}pPr/{_W}numPr") is not None or (style is not None and "list" in style.get(f"{_W}val", "").lower())
        text = said(paragraph)
        lines.append(f"- {text}" if listed and text.strip() else text)
    tables = body.findall(f"{_W}tbl")
    for table in tables:
        lines += [said(cell) for row in table.iter(f"{_W}tr") for cell in row.findall(f"{_W}tc")]
    return "\n".join(lines), len(tables), None


def read_files(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], tuple[str, int, str | None]]] | None = None) -> DataFrame:
    """path, kind, text, table_count, error of the files under ``path``; readers add or replace kinds.

    Each file is a row; too large and unknown ones are not opened. A PDF needs a reader.
    """
    plain = lambda content: (content.decode("utf-8", "replace"), 0, None)
    known = {"docx": docx_text, "txt": plain, "md": plain, **(readers or {})}

    @F.pandas_udf("text string, table_count int, error string")
    def run(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([known[k](c) if k in known and c is not None else ("", 0, "unsupported") for k, c in zip(kinds, contents, strict=True)], columns=["text", "table_count", "error"])

    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    small = F.when(F.col("length") <= MAX_FILE_BYTES, F.col("content"))
    rows = files.select("path", kind.alias("kind"), "length", run(kind, small).alias("r"))
    return rows.select("path", "kind", "r.text", "r.table_count", F.when(F.col("length") > MAX_FILE_BYTES, "too_large").otherwise(F.col("r.error")).alias("error"))
