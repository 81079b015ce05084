"""Queries of the readers on raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources import markup
from .registry import query, table


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = markup.read_markup(table(spark, sf_dir, "pages"), "page_id", "html")
    return out.select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.size("nodes").alias("n_nodes"), "error")


@query()
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    nodes = markup.node_rows(markup.read_markup(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")
    return nodes.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query()
def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    nodes = markup.node_rows(markup.read_markup(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")
    return markup.labelled_cells(nodes, "page_id")


@query("SELECT page_id, CASE WHEN length(trim(html)) = 0 OR html IS NULL THEN 'no_text' ELSE 'complete' END AS status, sha256(html) AS sha256 FROM pages")
def source_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import completeness

    return table(spark, sf_dir, "pages").select("page_id", completeness(F.col("html"), F.array().cast("array<int>")).alias("status"), F.sha2("html", 256).alias("sha256"))
