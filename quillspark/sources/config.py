"""Configuration files as dimension tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python import yaml_to_json

# File endings that can be taken in.
INGESTIBLE = (".md", ".pdf", ".docx", ".pptx", ".xlsx", ".xls", ".html", ".htm", ".txt", ".csv", ".json", ".xml", ".rst", ".rtf", ".epub", ".ipynb", ".yaml", ".yml", ".tsv", ".wav", ".mp3")


def ingestible(path: Column) -> Column:
    """Whether a file's ending, in any case, is one that can be taken in."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*INGESTIBLE)


def _members(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(ord, item): the members of a list in YAML files, each as JSON; missing and faulty files give none."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException:  # no such path
        return spark.createDataFrame([], "ord int, item string")
    found = files.select(yaml_to_json("value").alias("j"))
    return found.select(F.posexplode(F.from_json(F.get_json_object("j", f"$.{field}"), "array<string>")).alias("ord", "item"))


def watch_queries(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, query) of watch lists; entries without a query are passed over."""
    rows = _members(spark, path, "queries").select("ord", F.from_json("item", "name string, pubmed string").alias("q"))
    return rows.where("q.pubmed <> ''").select("ord", F.coalesce(F.when(F.col("q.name") != "", F.col("q.name")), "q.pubmed").alias("name"), F.col("q.pubmed").alias("query"))


def chapter_pages(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, page_ord, page_id) of chapter lists; chapter names as lowered slugs."""
    rows = _members(spark, path, "chapters").select(F.from_json("item", "name string, pages array<string>").alias("c"))
    slug = F.lower(F.btrim(F.regexp_replace("c.name", r"[^A-Za-z0-9]+", "-"), F.lit("-")))
    return rows.select(slug.alias("chapter"), F.posexplode("c.pages").alias("page_ord", "page_id"))
