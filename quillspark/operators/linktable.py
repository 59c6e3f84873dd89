"""Pages parsed once into tables of names and targets that many analyses share without a shuffle.

``store`` reads each text once. Names and targets are summed first and written in
buckets of the lowered name, so that a name that a third of all pages bear or link to
is one row of each, and the joins between the two need no shuffle. Rows of single
pages or links are joined to what those joins leave.

A page is (page_id, path, stem, targets), of which ``page_id`` is unique. Pages without
a stem bear no name; null targets are passed over, and null lists are empty.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinkTables:
    """parsed (page_id, path, stem_lc, targets), names (stem_lc, n_pages, owner), targets (stem_lc, target, n_pages, n_links)."""

    parsed: DataFrame
    names: DataFrame
    targets: DataFrame


def store(pages: DataFrame, folder: str, buckets: int | None = None) -> LinkTables:
    """Writes the tables below a new folder; ``buckets`` are as many as the session's shuffle partitions if not given."""
    spark = pages.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = F.coalesce(F.array_compact("targets"), F.array().cast("array<string>"))
    pages.select("page_id", "path", F.lower("stem").alias("stem_lc"), lists.alias("targets")).write.parquet(f"{folder}/parsed")
    parsed = spark.read.parquet(f"{folder}/parsed")

    def bucketed(rows: DataFrame, name: str) -> DataFrame:
        # the definition is only needed to read the table: its files stay
        definition = f"{name}_{uuid.uuid4().hex}"
        rows.repartition(n, "stem_lc").write.bucketBy(n, "stem_lc").sortBy("stem_lc").option("path", f"{folder}/{name}").saveAsTable(definition)
        read = spark.table(definition)
        spark.sql(f"DROP TABLE {definition}")
        return read

    names = parsed.where("stem_lc IS NOT NULL").groupBy("stem_lc").agg(F.count("*").alias("n_pages"), F.max(F.struct("path", "page_id")).getField("page_id").alias("owner"))
    # each target once for its page and once for each link, so that no pair of page and target is shuffled to be counted
    step = lambda pages, links: lambda t: F.struct(t.alias("target"), F.lit(pages).cast("long").alias("p"), F.lit(links).cast("long").alias("l"))
    steps = F.concat(F.transform(F.array_distinct("targets"), step(1, 0)), F.transform("targets", step(0, 1)))
    found = parsed.select(F.inline(steps)).groupBy("target").agg(F.sum("p").alias("n_pages"), F.sum("l").alias("n_links"))
    targets = found.select(F.lower("target").alias("stem_lc"), "target", "n_pages", "n_links")
    return LinkTables(parsed, bucketed(names, "names"), bucketed(targets, "targets"))


def missing_targets(tables: LinkTables) -> DataFrame:
    """(target, n_pages, n_links): what is linked to and no page's name, by spelling. No shuffle."""
    return tables.targets.join(tables.names.select("stem_lc"), "stem_lc", "left_anti").select("target", "n_pages", "n_links")


def named(tables: LinkTables) -> DataFrame:
    """(stem_lc, owner, n_pages, n_links): names with the pages that bear them and the links to them, in any spelling. No shuffle."""
    sums = tables.targets.groupBy("stem_lc").agg(F.sum("n_links").alias("n_links"))
    return tables.names.join(sums, "stem_lc", "left").select("stem_lc", "owner", "n_pages", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def unlinked_pages(tables: LinkTables) -> DataFrame:
    """(page_id): pages whose name no link has, and those without a name."""
    linked = named(tables).where("n_links > 0").select("stem_lc")
    return tables.parsed.select("page_id", "stem_lc").join(linked, "stem_lc", "left_anti").select("page_id")


def broken_links(tables: LinkTables) -> DataFrame:
    """(page_id, target, n_links): pages' links to names that no page bears."""
    missing = missing_targets(tables).select("target")
    links = tables.parsed.select("page_id", F.explode("targets").alias("target"))
    return links.join(missing, "target", "left_semi").groupBy("page_id", "target").agg(F.count("*").alias("n_links"))


def link_report(tables: LinkTables, least_pages: int = 2, least_links: int = 3) -> DataFrame:
    """(section, item, n): phantoms by pages, missing entities by links, broken links by page, unlinked pages, links to each name's owner, and totals."""
    missing = missing_targets(tables)
    row = lambda df, section, item, n: df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), n.cast("long").alias("n"))
    totals = missing.agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("n"))
    parts = [
        row(missing.where(F.col("n_pages") >= least_pages), "phantoms", F.col("target"), F.col("n_pages")),
        row(missing.where(F.col("n_links") >= least_links), "missing", F.col("target"), F.col("n_links")),
        row(broken_links(tables).groupBy("page_id").agg(F.sum("n_links").alias("n")), "broken", F.col("page_id"), F.col("n")),
        row(unlinked_pages(tables), "unlinked", F.col("page_id"), F.lit(0)),
        row(named(tables).where("n_links > 0"), "linked", F.col("owner"), F.col("n_links")),
        row(totals, "total", F.lit("broken"), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
