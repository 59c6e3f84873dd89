"""Tables of what outside services and tools answered; an absent row means unknown, not no."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

SCHEMAS = {
    "doi_validation": "doi string, valid boolean",
    "doi_metadata": "doi string, title string, first_author string, year string, journal string",
    "search_hits": "query_hash string, rank int, score double, overlap double, title string, doi string",
    "forward_citers": "source_doi string, since_year int, doi string, title string, authors array<string>, year int, venue string, venue_h int, citations int",
    "pubmed_hits": "query_name string, pmid string, title string, authors array<string>, journal string, year string, doi string",
    "fetch_results": "doi string, status string, source string, version string, license string, path string, title_sim double, note string, attempts array<struct<source: string, found: boolean, url: string, version: string, download_status: string, verification: string, title_sim: double, meta_status: string, error: string, skipped: boolean>>",
    "conversion_report": "ok array<struct<pdf: string, chars: long, sec: double>>, skipped array<string>, suspicious array<struct<pdf: string, chars: long, sec: double>>, errors array<struct<pdf: string, error: string>>",
    "lint_cache": "sha256 string, path string, check string, agent_version string, pass boolean, severity string, details string",
    "blame": "line_num int, commit string, author string, timestamp long, summary string, content string",
    "changes": "path string, ts long",
}


def snapshot(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A snapshot table from JSON lines, with its fixed schema; ``faulty`` has the lines that don't fit it."""
    return _lines(spark, name, path).where("corrupt is null").drop("corrupt")


def faulty(spark: SparkSession, name: str, path: str) -> DataFrame:
    """(corrupt): the lines of a snapshot that its schema can't read, whole."""
    return _lines(spark, name, path).where("corrupt is not null").select("corrupt")


def _lines(spark: SparkSession, name: str, path: str) -> DataFrame:
    lines = spark.read.text(path)
    row = F.from_json("value", f"{SCHEMAS[name]}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return lines.where("trim(value) <> ''").select(row.alias("r")).select("r.*")


def inference_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, to, type, confidence, relationship) of a JSON-lines checkpoint: faulty lines and edges without a target are passed over."""
    schema = "page_id string, edges array<struct<to: string, type: string, confidence: double, relationship: string>>, ts string"
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r.page_id is not null")
    e = rows.select("r.page_id", F.explode("r.edges").alias("e")).where("e.to is not null")
    return e.select("page_id", "e.to", F.coalesce("e.type", F.lit("INFERRED")).alias("type"), F.coalesce("e.confidence", F.lit(0.7)).alias("confidence"), "e.relationship")


def graph_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of a graph file; None if it can't be read."""
    try:
        rows = spark.read.option("multiLine", "true").json(path)
        return rows.select(F.explode("nodes").alias("n")).select("n.*"), rows.select(F.explode("edges").alias("e")).select("e.*")
    except Exception:  # a corrupt or missing file counts as no graph
        return None


def blame_rows(spark: SparkSession, porcelain: DataFrame) -> DataFrame:
    """(page_id, line_num, commit, author, timestamp, summary, content) of git blame's porcelain text (page_id, text)."""
    pattern = r"(?m)^([0-9a-f]{40}) \d+ (\d+)(?: \d+)?\n((?:[^\t].*\n)*)\t(.*)$"
    rows = porcelain.select("page_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("i", "m"))
    part = lambda k: F.regexp_extract("m", pattern, k)
    head = part(3)
    rows = rows.select("page_id", part(2).cast("int").alias("line_num"), part(1).alias("commit"), X.first_group(head, r"(?m)^author (.*)$").alias("author"), X.first_group(head, r"(?m)^author-time (\d+)$").cast("long").alias("timestamp"), X.first_group(head, r"(?m)^summary (.*)$").alias("summary"), part(4).alias("content"))
    # a commit's header stands at its first line alone
    known = rows.where("timestamp is not null").groupBy("page_id", "commit").agg(F.first("author").alias("author"), F.first("timestamp").alias("timestamp"), F.first("summary").alias("summary"))
    return rows.select("page_id", "line_num", "commit", "content").join(known, ["page_id", "commit"], "left").select("page_id", "line_num", "commit", "author", "timestamp", "summary", "content")


def changed_since(changes: DataFrame, pages: DataFrame, since: int) -> DataFrame:
    """Pages that a change log (path, ts) touched since a time."""
    return pages.join(changes.where(F.col("ts") >= since).select("path").distinct(), "path", "left_semi")


def validated(dois: DataFrame, validation: DataFrame) -> DataFrame:
    """(doi, valid): what the snapshot doesn't know counts as valid."""
    return dois.join(validation, "doi", "left").select("doi", F.coalesce("valid", F.lit(True)).alias("valid"))


def expected_titles(spark: SparkSession, path: str) -> DataFrame:
    """(doi, title) of a CSV file with a header."""
    rows = spark.read.option("header", "true").csv(path)
    names = {c.lower(): c for c in rows.columns}
    return rows.select(X.normalize_doi(F.col(names["doi"])).alias("doi"), F.col(names["title"]).alias("title")).where("doi <> ''")
