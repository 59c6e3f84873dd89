"""Builds the link graph of a table of pages: pages with their degrees and standing, edges, and links to no page.

    python -m jobs.link_tables --input PAGES --output GRAPH [--config jobs/link_tables.json]

The config has the columns and three patterns, each with one group: what a link
names, and a page's stem and kind. A link names the page whose stem it has, whatever
its letter case; of several pages the one with the greatest id.

    GRAPH/parsed/kind=..   page_id, address, stem, links: all that is taken from the texts
    GRAPH/nodes/kind=..    page_id, stem, address, n_in, n_out, degree, standing (hub, orphan or page)
    GRAPH/edges/kind=..    from, to, by the kind of the page that links
    GRAPH/broken/kind=..   target, n_pages, n_links: names without a page, by the kind of the pages that link

Texts are read once, for ``parsed``; the rest is made from that. Each table is
overwritten, so a second run gives the same. Null texts have no links and no stem; a
page without a kind has the kind ``none``; ids must be unique.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import graph

log = logging.getLogger("link_tables")

TABLES = {
    "parsed": "page_id string, address string, stem string, links array<string>, kind string",
    "nodes": "page_id string, stem string, address string, n_in long, n_out long, degree long, standing string, kind string",
    "edges": "`from` string, `to` string, kind string",
    "broken": "target string, n_pages long, n_links long, kind string",
}


def table(spark: SparkSession, output: str, name: str) -> DataFrame:
    """One of the tables as the last run wrote it."""
    return spark.read.schema(TABLES[name]).parquet(f"{output}/{name}")


def parsed(rows: DataFrame, config: dict) -> DataFrame:
    """What the config's patterns find in each page."""
    text = F.coalesce(F.col(config["text"]), F.lit(""))
    first = lambda name: F.regexp_extract(text, config[name], 1)
    kind = F.when(first("kind") != "", first("kind")).otherwise("none")
    return rows.select(
        F.col(config["id"]).cast("string").alias("page_id"),
        F.col(config["address"]).cast("string").alias("address"),
        F.when(first("stem") != "", first("stem")).alias("stem"),
        F.regexp_extract_all(text, F.lit(config["link"]), F.lit(1)).alias("links"),
        kind.alias("kind"),
    )


def run(spark: SparkSession, source: str, output: str, config: dict) -> dict[str, int]:
    """Writes the four tables; returns the rows of each."""

    def write(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{output}/{name}")
        return table(spark, output, name)

    pages = write(parsed(spark.read.parquet(source), config), "parsed")
    named = pages.select("page_id", "stem", F.col("page_id").alias("path"))
    links = pages.select("page_id", F.explode("links").alias("target"))
    kinds = pages.select("page_id", "kind")
    directed = graph.resolve(links, named).withColumnsRenamed({"src": "from", "dst": "to"})
    edges = write(directed.join(kinds.withColumnRenamed("page_id", "from"), "from").select("from", "to", "kind"), "edges")

    both = graph.undirected(edges.select("from", "to", F.lit(1.0).alias("confidence")))
    degree = graph.degrees(pages.select(F.col("page_id").alias("id")), both)
    count = lambda end, name: edges.groupBy(F.col(end).alias("page_id")).agg(F.count("*").alias(name))
    mark = lambda rows, name: rows.select("page_id", F.lit(True).alias(name))
    hubs = mark(graph.god_nodes(degree).withColumnRenamed("id", "page_id"), "hub")
    alone = mark(graph.orphans(links, named, tuple(config["exempt"])), "orphan")
    rows = pages.drop("links").join(degree.withColumnRenamed("id", "page_id"), "page_id")
    for part in (count("to", "n_in"), count("from", "n_out"), hubs, alone):
        rows = rows.join(part, "page_id", "left")
    none = F.lit(0).cast("long")
    standing = F.when(F.col("hub"), "hub").when(F.col("orphan"), "orphan").otherwise("page")
    write(rows.select("page_id", "stem", "address", F.coalesce("n_in", none).alias("n_in"), F.coalesce("n_out", none).alias("n_out"), "degree", standing.alias("standing"), "kind"), "nodes")

    missing = graph.broken_links(links, named.where("stem is not null")).groupBy("page_id", "target").agg(F.count("*").alias("n"))
    missing = missing.join(kinds, "page_id").groupBy("target", "kind").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_links"))
    write(missing.select("target", "n_pages", "n_links", "kind"), "broken")

    done = {name: table(spark, output, name).count() for name in TABLES}
    log.info("read %d pages of %s, wrote %s to %s", done["parsed"], source, ", ".join(f"{n} {name}" for name, n in done.items()), output)
    return done


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    a = p.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from quillspark.session import session

    spark = session("link_tables")
    try:
        run(spark, a.input, a.output, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
