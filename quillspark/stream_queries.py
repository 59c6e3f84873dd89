"""Registered queries over streams: each runs a stream twice over files that grow, and gives back what it keeps then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import PAGES, cte, query, view
from .session import shared_folder
from .streaming import graph_changes, seen

KEEP_HOURS = 6
_HALF = "2024-01-16"

_GRAPH_SQL = (
    cte(p=PAGES)
    + """, f AS (SELECT page_id, path, CASE WHEN page_id::BIGINT % 10 = 1 THEN 'n' || page_id ELSE stem END AS stem,
  CASE WHEN page_id::BIGINT % 10 = 2 THEN ['n' || (page_id::BIGINT - 1)] ELSE regexp_extract_all(content, 'href="/([^"]+)"', 1) END AS t
  FROM p WHERE page_id::BIGINT % 10 <> 0),
l AS (SELECT DISTINCT page_id, lower(t) AS s FROM (SELECT page_id, unnest(t) AS t FROM f)),
st AS (SELECT lower(stem) AS s, arg_max(page_id, path) AS dst FROM f GROUP BY 1),
e AS (SELECT DISTINCT page_id AS src, dst FROM l JOIN st USING (s) WHERE page_id <> dst),
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e)
SELECT 'edge' AS part, src AS a, dst AS b, NULL::BIGINT AS n FROM e
UNION ALL SELECT 'page', page_id, NULL, count(x.id)::BIGINT FROM f LEFT JOIN (SELECT a AS id FROM u UNION ALL SELECT b FROM u) x ON x.id = page_id GROUP BY page_id
UNION ALL SELECT 'missing', s, NULL, count(*)::BIGINT FROM l WHERE s NOT IN (SELECT s FROM st) GROUP BY s
"""
)


@query(_GRAPH_SQL)
def stream_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after all pages came, then some went, some got another name, some other links, and some an outdated version.

    The SQL builds it at once from the pages as they are at the end.
    """
    top = shared_folder(spark, "graph-changes")
    n = F.col("page_id").cast("long")
    found = F.regexp_extract_all("content", F.lit('href="/([^"]+)"'), F.lit(1))
    first = view(spark, sf_dir, PAGES).select("page_id", "path", "stem", F.lit(1).cast("long").alias("version"), found.alias("targets"))
    away = F.array(F.concat(F.lit("n"), (n - 1).cast("string")))
    then = first.where(n % 10 <= 3).select(
        "page_id",
        "path",
        F.when(n % 10 == 1, F.concat(F.lit("n"), "page_id")).otherwise(F.col("stem")).alias("stem"),
        F.when(n % 10 == 3, 0).otherwise(2).cast("long").alias("version"),
        F.when(n % 10 == 0, F.lit(None)).when(n % 10 == 1, F.col("targets")).otherwise(away).alias("targets"),
    )
    for rows in (first, then):
        rows.write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema(graph_changes.CHANGES).parquet(f"{top}/in")
        graph_changes.maintain(stream, f"{top}/out", f"{top}/mark").awaitTermination()
    word, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    parts = [
        graph_changes.directed_edges(spark, f"{top}/out").select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), none.alias("n")),
        graph_changes.degrees(spark, f"{top}/out").select(F.lit("page"), "id", word, "degree"),
        graph_changes.missing_names(spark, f"{top}/out").select(F.lit("missing"), "stem_lc", word, "n_pages"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""
WITH RECURSIVE h AS (SELECT user_id::VARCHAR AS key, ts FROM events WHERE ts IS NOT NULL),
r AS (SELECT key, min(ts) AS ts FROM h GROUP BY key
  UNION ALL SELECT h.key, min(h.ts) FROM r JOIN h ON h.key IS NOT DISTINCT FROM r.key AND h.ts >= r.ts + INTERVAL {KEEP_HOURS} HOUR GROUP BY h.key)
SELECT key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time FROM r
""")
def stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of users that were not reported in the hours before; the second run's files repeat half a day of the first's."""
    top = shared_folder(spark, "unseen")
    hits = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    half = F.lit(_HALF).cast("timestamp")
    for rows in (hits.where(F.col("ts") < half), hits.where(F.col("ts") >= half - F.expr("interval 12 hours"))):
        rows.write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{top}/in")
        seen.watch(stream, "user_id", "ts", f"{top}/out", f"{top}/mark", KEEP_HOURS * 3600, "1 day").awaitTermination()
    new = spark.read.schema("key string, time timestamp").parquet(f"{top}/out")
    return new.select("key", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"))
