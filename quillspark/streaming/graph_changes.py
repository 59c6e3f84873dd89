"""The link graph of a growing and changing collection of pages, kept by what changed.

A change is a row (page_id, path, stem, version, targets): a page as it is from that
version on, with the names that it links to, or with null ``targets`` a page that is
gone. Each batch of changes writes rows of its own to five tables, with +1 for what
came and -1 for what went, and a table as it stands is the sum of its batches:

    pages/batch=..    the versions that were taken
    links/batch=..    (page_id, stem_lc, n), distinct lowered targets of pages
    names/batch=..    (stem_lc, path, page_id, n), the pages that bear a name
    edges/batch=..    (src, dst, n), directed, without self links
    degrees/batch=..  (id, n), of the undirected graph

Only the links of changed pages are read anew, and those to names whose owner changed.
Of equal versions of a page the one with the greater digest counts, and a version
older than the one in force is passed over, so any order and any split of the same
changes gives the same tables. A batch overwrites its own partitions and reads earlier
ones besides, so one that runs again after a failure writes what it wrote before; a
reader should wait for the end of a batch.

Rows without an id are no pages and are left out; a null version is the oldest; a
page without a stem bears no name; null targets within the list are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGES = "page_id string, path string, stem string, version long, targets array<string>"
TABLES = {
    "pages": "page_id string, path string, stem_lc string, version long, digest string, targets array<string>",
    "links": "page_id string, stem_lc string, n long",
    "names": "stem_lc string, path string, page_id string, n long",
    "edges": "src string, dst string, n long",
    "degrees": "id string, n long",
}
#: The batch of the sums that ``compact`` writes; streams number theirs from 0.
BASE = -1
OLDEST = -(2**63)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of a table, with their batch."""
    return spark.read.schema(f"{TABLES[name]}, batch long").parquet(f"{root}/{name}")


def prepare(spark: SparkSession, root: str) -> None:
    """Makes empty tables where there are none, so that the first batch can read them."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], f"{schema}, batch long").write.mode("ignore").partitionBy("batch").parquet(f"{root}/{name}")


def maintain(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Takes what is new in a stream of changes into the tables below ``root``, and ends."""
    prepare(changes.sparkSession, root)
    return changes.writeStream.foreachBatch(lambda rows, batch: take(rows, root, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _signed(rows: DataFrame) -> DataFrame:
    keys = [c for c in rows.columns if c != "n"]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def _in_force(versions: DataFrame) -> DataFrame:
    facts = [c for c in versions.columns if c not in ("page_id", "batch")]
    return versions.groupBy("page_id").agg(F.max_by(F.struct(*facts), F.struct("version", "digest")).alias("v")).select("page_id", "v.*")


def take(changes: DataFrame, root: str, batch: int) -> None:
    """Writes what a batch of changes brings to each table; ``prepare`` comes before the first."""
    spark = changes.sparkSession

    def write(name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        return table(spark, root, name).where(F.col("batch") == batch).drop("batch")

    def before(name: str) -> DataFrame:
        return table(spark, root, name).where(F.col("batch") < batch)

    def until(name: str) -> DataFrame:
        return table(spark, root, name).where(F.col("batch") <= batch)

    targets = F.array_sort(F.array_distinct(F.transform(F.array_compact("targets"), F.lower)))
    asked = changes.where("page_id IS NOT NULL").select("page_id", "path", F.lower("stem").alias("stem_lc"), F.coalesce("version", F.lit(OLDEST)).alias("version"), targets.alias("targets"))
    asked = _in_force(asked.withColumn("digest", F.sha2(F.to_json(F.struct("path", "stem_lc", "targets")), 256)))
    known = _in_force(before("pages").join(asked.select("page_id"), "page_id", "left_semi")).select("page_id", F.struct("version", "digest").alias("last"))
    newer = F.col("last").isNull() | (F.struct("version", "digest") > F.col("last"))
    fresh = write("pages", asked.join(known, "page_id", "left").where(newer).select("page_id", "path", "stem_lc", "version", "digest", "targets"))

    gone = _in_force(before("pages").join(fresh.select("page_id"), "page_id", "left_semi"))
    both = fresh.select("*", F.lit(1).cast("long").alias("n")).unionByName(gone.select("*", F.lit(-1).cast("long").alias("n"))).where("targets IS NOT NULL")
    links = write("links", _signed(both.select("page_id", F.explode("targets").alias("stem_lc"), "n")))
    names = write("names", _signed(both.where("stem_lc IS NOT NULL").select("stem_lc", "path", "page_id", "n")))
    edges = write("edges", _edge_changes(links, names, before("links"), until("names"), batch))
    write("degrees", _degree_changes(edges, until("edges"), batch))


def _was_and_is(rows: DataFrame, keys: list[str | Column], batch: int) -> DataFrame:
    """Sums before and after a batch."""
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("batch") < batch, F.col("n"))), F.lit(0)).alias("was"), F.sum("n").alias("is"))


def _edge_changes(links: DataFrame, names: DataFrame, old_links: DataFrame, all_names: DataFrame, batch: int) -> DataFrame:
    """Changed links meet the owners that names have now, and links as they were meet changed owners: each change is met once."""
    stems = links.select("stem_lc").union(names.select("stem_lc")).distinct()
    bearers = _was_and_is(all_names.join(stems, "stem_lc", "left_semi"), ["stem_lc", "path", "page_id"], batch)
    owner = lambda held: F.max(F.when(F.col(held) > 0, F.struct("path", "page_id"))).getField("page_id").alias(held)
    owners = bearers.groupBy("stem_lc").agg(owner("was"), owner("is"))
    met = links.join(owners, "stem_lc").select(F.col("page_id").alias("src"), F.col("is").alias("dst"), "n")
    moved = old_links.join(owners.where(~F.col("was").eqNullSafe(F.col("is"))), "stem_lc")
    ends = F.inline(F.array(F.struct(F.col("is").alias("dst"), F.col("n").alias("n")), F.struct(F.col("was").alias("dst"), (-F.col("n")).alias("n"))))
    return _signed(met.union(moved.select(F.col("page_id").alias("src"), ends)).where("dst IS NOT NULL AND src <> dst"))


def _degree_changes(edges: DataFrame, all_edges: DataFrame, batch: int) -> DataFrame:
    """A pair of pages counts once for each of them, whichever way its edges go."""
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    touched = edges.select(*pair).distinct()
    sums = _was_and_is(all_edges.select(*pair, "n", "batch").join(touched, ["a", "b"], "left_semi"), ["a", "b"], batch)
    step = (F.col("is") > 0).cast("long") - (F.col("was") > 0).cast("long")
    return _signed(sums.select(F.explode(F.array("a", "b")).alias("id"), step.alias("n")))


# the tables as they stand


def live_pages(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, path, stem_lc) of pages that are not gone."""
    return _in_force(table(spark, root, "pages")).where("targets IS NOT NULL").select("page_id", "path", "stem_lc")


def directed_edges(spark: SparkSession, root: str) -> DataFrame:
    """(src, dst)."""
    return _signed(table(spark, root, "edges").drop("batch")).select("src", "dst")


def degrees(spark: SparkSession, root: str) -> DataFrame:
    """(id, degree) of every live page."""
    ids = live_pages(spark, root).select(F.col("page_id").alias("id"))
    return ids.join(_signed(table(spark, root, "degrees").drop("batch")), "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def missing_names(spark: SparkSession, root: str) -> DataFrame:
    """(stem_lc, n_pages): names that no live page bears, and how many pages link to them."""
    wanted = _signed(table(spark, root, "links").drop("batch")).groupBy("stem_lc").agg(F.count("*").alias("n_pages"))
    return wanted.join(live_pages(spark, root).select("stem_lc"), "stem_lc", "left_anti")


def compact(spark: SparkSession, root: str, fresh: str) -> None:
    """Writes each table's sum as one batch to the new folder ``fresh``, with which the same stream and checkpoint may go on; gone pages are kept as such."""
    for name in TABLES:
        rows = table(spark, root, name)
        rows = _in_force(rows) if name == "pages" else _signed(rows.drop("batch"))
        rows.write.mode("overwrite").parquet(f"{fresh}/{name}/batch={BASE}")
