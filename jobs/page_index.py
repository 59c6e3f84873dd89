"""Keeps an index of a growing collection of pages, and its coverage by kind and depth.

    python -m jobs.page_index --input PAGES --output INDEX --checkpoint MARK [--config jobs/page_index.json]

The input is a Parquet folder, or a pattern, to which files are added; a page that was rewritten comes
again in a new file. A file stream takes the files that its checkpoint doesn't
know, in one or more batches, and ends when there are none left.

    INDEX/pages/kind=../batch=..   one row for each version of a page, by the batch that brought it
    INDEX/coverage/kind=..         pages of each depth and their share, of the versions in force

A version is written only if the page is new or its kind or text changed, so the same
pages in further files add nothing. A batch overwrites its own partitions and compares
with earlier batches only: run again after a failure, it writes what it wrote before.
Coverage is made anew from the index at the end of every run. Texts are read once and
never shuffled; a batch shuffles its pages' numbers and the index's ids and digests.

Null texts count as empty. Rows without an id are one page; so are rows that share one,
of which the file that was changed last wins, then the greatest digest. A null or empty
kind is ``none``. Files must not change once they are there.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X

log = logging.getLogger("page_index")

NUMBERS = ("n_words", "n_sentences", "n_terms", "n_links", "n_dois")
INDEX = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("page_id", "sha256", "depth")]
    + [T.StructField(c, T.LongType()) for c in NUMBERS]
    + [T.StructField("kind", T.StringType()), T.StructField("batch", T.LongType())]
)
COVERAGE = "depth string, n long, share double, kind string"


def page_facts(rows: DataFrame, config: dict) -> DataFrame:
    """The columns of the index but for the batch, and ``changed``, the time at which the row's file was."""
    text = F.coalesce(F.col(config["text"]), F.lit(""))
    kind = F.coalesce(F.when(F.col(config["kind"]).cast("string") != "", F.col(config["kind"]).cast("string")), F.lit("none"))
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.btrim(s)) >= config["least_sentence"])
    n_words = X.word_count(text)
    sizes = dict(zip(NUMBERS, (n_words, F.size(sentences), F.size(X.tokens(text)), F.size(X.loose_links(text)), F.size(X.extract_dois(text))), strict=True))
    return rows.select(
        F.col(config["id"]).cast("string").alias("page_id"),
        F.sha2(text.cast("binary"), 256).alias("sha256"),
        X.depth_label(n_words).alias("depth"),
        *(n.cast("long").alias(c) for c, n in sizes.items()),
        kind.alias("kind"),
        F.col("_metadata.file_modification_time").alias("changed"),
    )


def versions(spark: SparkSession, output: str) -> DataFrame:
    """All rows of the index."""
    return spark.read.schema(INDEX).parquet(f"{output}/pages")


def in_force(rows: DataFrame) -> DataFrame:
    """The last version of each page, and how many it has."""
    facts = [c for c in rows.columns if c != "page_id"]
    last = rows.groupBy("page_id").agg(F.max_by(F.struct(*facts), "batch").alias("v"), F.count("*").alias("versions"))
    return last.select("page_id", *(f"v.{c}" for c in facts), "versions")


def coverage(spark: SparkSession, output: str) -> DataFrame:
    """(kind, depth, n, share) as the last run wrote it."""
    return spark.read.schema(COVERAGE).parquet(f"{output}/coverage")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes what is new in ``source``; returns how many batches it took, rows it read and versions it wrote."""
    # an empty table the first time, so that each batch can read what is there
    spark.createDataFrame([], INDEX).write.mode("ignore").partitionBy("kind", "batch").parquet(f"{output}/pages")
    wanted = [config[c] for c in ("id", "kind", "text")]
    schema = T.StructType([f for f in spark.read.parquet(source).schema if f.name in wanted])
    done = {"batches": 0, "read": 0, "written": 0}

    def take(rows: DataFrame, batch: int) -> None:
        facts = [c for c in rows.columns if c not in ("page_id", "changed")]
        latest = rows.groupBy("page_id").agg(F.max_by(F.struct(*facts), F.struct("changed", "sha256", "kind")).alias("v"))
        latest = latest.select("page_id", *(f"v.{c}" for c in facts)).alias("a")
        known = in_force(versions(rows.sparkSession, output).where(F.col("batch") < batch)).alias("b")
        same = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.sha256") == F.col("b.sha256")) & (F.col("a.kind") == F.col("b.kind"))
        fresh = latest.join(known, same, "left_anti").withColumn("batch", F.lit(batch).cast("long"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(f"{output}/pages")
        written = versions(rows.sparkSession, output).where(F.col("batch") == batch).count()
        done["batches"] += 1
        done["written"] += written
        log.info("batch %d: wrote %d versions", batch, written)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    query = page_facts(stream, config).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done["read"] = sum(p["numInputRows"] for p in query.recentProgress)
    pages = in_force(versions(spark, output))
    counts = pages.groupBy("kind", "depth").agg(F.count("*").alias("n"))
    total = counts.groupBy("kind").agg(F.sum("n").alias("all"))
    shares = counts.join(total, "kind").select("depth", "n", F.round(100 * F.col("n") / F.col("all"), 1).alias("share"), "kind")
    shares.coalesce(1).write.mode("overwrite").partitionBy("kind").parquet(f"{output}/coverage")  # three rows a kind
    log.info("read %d rows of %s in %d batches, wrote %d versions to %s", done["read"], source, done["batches"], done["written"], output)
    return done


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    a = p.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from quillspark.session import session

    spark = session("page_index")
    try:
        run(spark, a.input, a.output, a.checkpoint, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
