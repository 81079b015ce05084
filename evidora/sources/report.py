"""An HTML report of decisions, and the objects of a packet for the store."""

from __future__ import annotations

import html
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAGE = "<!DOCTYPE html><html lang=en><meta charset=utf-8><title>Decisions</title><style>body{font:15px sans-serif;max-width:70em;margin:auto}td,th{text-align:left;padding:.2em .8em;vertical-align:top}.rejected{color:#a00}.needs_verification{color:#a60}mark{background:#fe8}</style>"


def escape(text: object) -> str:
    """Text for HTML, control characters shown as codes."""
    shown = "".join(c if c >= " " and c != "\x7f" or c in "\n\t" else f"\\x{ord(c):02x}" for c in str(text))
    return html.escape(shown)


def report(rows: list[dict[str, Any]], text: str, context: int = 60) -> str:
    """One document's decisions with the evidence in its surroundings. rows: decisions of the document."""
    raw = text.encode()
    out = [_PAGE, "<table><tr><th>Field<th>Value<th>Outcome<th>Codes<th>Evidence</tr>"]
    for r in rows:
        cited = ""
        if r.get("start") is not None and r.get("source") == "document":
            cut = lambda a, b: escape(raw[max(0, a) : b].decode("utf-8", "ignore"))
            cited = f"{cut(r['start'] - context, r['start'])}<mark>{cut(r['start'], r['end'])}</mark>{cut(r['end'], r['end'] + context)}"
        value = escape(r["value"] if r["value"] is not None else "") + (f" {escape(r['unit'])}" if r.get("unit") else "")
        out.append(f"<tr class={escape(r['outcome'])}><td>{escape(r['field'])}{' (' + escape(r['key']) + ')' if r.get('key') else ''}<td>{value}<td>{escape(r['outcome'])}<td>{escape(', '.join(r['codes']))}<td>{cited}</tr>")
    return "".join([*out, "</table>"])


def packet_objects(packets: DataFrame, receipts: DataFrame) -> DataFrame:
    """(kind, bytes): texts, candidates and receipts of packets, for Store.put()."""
    texts = packets.select(F.lit("text").alias("kind"), F.col("text").cast("binary").alias("bytes"))
    candidates = packets.select(F.explode("candidates").alias("c")).select(F.lit("candidate").alias("kind"), F.col("c").cast("binary").alias("bytes"))
    sealed = receipts.select(F.lit("receipt").alias("kind"), F.col("receipt").cast("binary").alias("bytes"))
    return texts.unionByName(candidates).unionByName(sealed).filter(F.col("bytes").isNotNull())
