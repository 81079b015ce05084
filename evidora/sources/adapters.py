"""Annotated documents of other extractors as candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import byte_offset


def annotated(docs: DataFrame, id_col: str, text_col: str, extractions: str, fields: dict[str, str], units: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text, candidates) from ARRAY<STRUCT<class, text, start, end>> of code-point spans; start and end may be null.

    fields: class of an extraction -> field. Extractions of other classes are left out. Columns only.
    """
    table = F.create_map(*(F.lit(x) for kv in fields.items() for x in kv))
    unit_of = F.create_map(*(F.lit(x) for kv in (units or {"": ""}).items() for x in kv))

    def candidate(x: Column) -> Column:
        field = table[x["class"]]
        text = F.col(text_col)
        spanned = x["start"].isNotNull() & x["end"].isNotNull()
        item = F.struct(F.when(spanned, byte_offset(text, x["start"])).alias("start"), F.when(spanned, byte_offset(text, x["end"])).alias("end"), x["text"].alias("text"))
        return F.to_json(F.struct(field.alias("field"), x["text"].alias("value"), unit_of[field].alias("unit"), F.array(item).alias("evidence")))

    known = F.filter(F.col(extractions), lambda x: table[x["class"]].isNotNull())
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.transform(known, candidate).alias("candidates"))
