"""Files of any known format to texts, nodes, digests and completeness."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import _NODE, NODE, html, xml
from .office import docx, xlsx

FORMATS = {"html": "html", "htm": "html", "xhtml": "html", "xml": "xml", "docx": "docx", "xlsx": "xlsx", "pdf": "pdf", "txt": "text", "md": "text", "text": "text"}


def text_of(data: bytes) -> str:
    """UTF-8, a byte order mark dropped, line ends as \\n, NFC."""
    return unicodedata.normalize("NFC", data.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n"))


def file_format(path: Column) -> Column:
    """The format that a path's suffix names; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return table[suffix]


def read_one(data: bytes, kind: str | None) -> tuple[str, list[dict]]:
    if kind == "text":
        return text_of(data), []
    if kind == "html":
        return html(data.decode("utf-8-sig", "replace"))
    if kind == "xml":
        return xml(data)
    if kind == "docx":
        return docx(data)
    if kind == "xlsx":
        return xlsx(data)
    raise ValueError(f"no reader for {kind or 'this suffix'}")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, format, sha256, bytes, text, nodes, completeness, error): a row for each file under a path.

    PDF and OCR need libraries that are no part of this package; such a file gets a row with an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", file_format(F.col("path")).alias("format"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                text = nodes = error = None
                try:
                    text, nodes = read_one(r.column(4)[0].as_py(), r.column(1)[0].as_py())
                except Exception as e:  # noqa: BLE001  a file that cannot be read fails alone
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([*r.columns[:4], pa.array([text], pa.string()), pa.array([nodes], pa.list_(_NODE)), pa.array([error], pa.string())], names=["path", "format", "sha256", "bytes", "text", "nodes", "error"])

    out = rows.mapInArrow(run, f"path string, format string, sha256 string, bytes long, text string, nodes array<{NODE}>, error string")
    return out.withColumn("completeness", completeness(F.col("text"), F.array().cast("array<int>")))


def completeness(text: Column, missing: Column) -> Column:
    """no_text, partial or complete."""
    return F.when(text.isNull() | (F.length(F.trim(text)) == 0), "no_text").when(F.size(missing) > 0, "partial").otherwise("complete")
