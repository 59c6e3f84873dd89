"""The jobs as registered queries: each runs twice into one new folder and gives back what lies there then."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import STOPWORDS
from quillspark.queries import query
from quillspark.session import shared_folder

from . import link_tables, page_index


def _config(job) -> dict:
    return json.loads(Path(job.__file__).with_suffix(".json").read_text())


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_INDEX_SQL = rf"""
WITH d AS (SELECT doc_id::VARCHAR AS page_id, coalesce(nullif(lang, ''), 'none') AS kind, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS n FROM d),
f AS (SELECT page_id, kind, sha256(text) AS sha256, n::BIGINT AS n_words,
  CASE WHEN n < 500 THEN 'stub' WHEN n < 1500 THEN 'page' ELSE 'chapter' END AS depth,
  len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: length(trim(x)) >= 20))::BIGINT AS n_sentences,
  len(list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z\-]{{2,}}'), lambda x: lower(x))),
      lambda x: x NOT IN ({_STOP})))::BIGINT AS n_terms,
  len(regexp_extract_all(text, '\[\[([^\]]+)\]\]'))::BIGINT AS n_links,
  len(list_distinct(list_transform(regexp_extract_all(text, '10\.\d{{4,9}}/[^\s]+'), lambda x: lower(x))))::BIGINT AS n_dois,
  1::BIGINT AS versions FROM w),
c AS (SELECT kind, depth, count(*)::BIGINT AS n FROM f GROUP BY ALL),
s AS (SELECT kind, depth, n, round(n * 100.0 / sum(n) OVER (PARTITION BY kind), 1)::DOUBLE AS share FROM c)
SELECT f.*, s.n AS n_of_depth, s.share FROM f JOIN s USING (kind, depth)
"""


@query(_INDEX_SQL)
def job1_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions in force with the coverage of their kind and depth; ``versions`` is 1 as the second run finds nothing new."""
    top = shared_folder(spark, "job1")
    source = f"{sf_dir}/documents.parque[t]"  # a pattern matches a folder or a single file; a stream takes a file by pattern only
    for _ in range(2):
        page_index.run(spark, source, f"{top}/out", f"{top}/mark", _config(page_index))
    pages = page_index.in_force(page_index.versions(spark, f"{top}/out")).drop("batch")
    return pages.join(page_index.coverage(spark, f"{top}/out").withColumnRenamed("n", "n_of_depth"), ["kind", "depth"])


_LINKS_SQL = r"""
WITH p AS (SELECT page_id::VARCHAR AS page_id, url AS address, nullif(regexp_extract(html, '<title>([^ <]+)', 1), '') AS stem,
  coalesce(nullif(regexp_extract(html, '<html lang="([^"]+)"', 1), ''), 'none') AS kind, regexp_extract_all(html, 'href="/([^"]+)"', 1) AS t FROM pages),
l AS (SELECT page_id, kind, unnest(t) AS target FROM p),
o AS (SELECT lower(stem) AS s, max(page_id) AS dst FROM p WHERE stem IS NOT NULL GROUP BY 1),
e AS (SELECT DISTINCT page_id AS src, dst, kind FROM l JOIN o ON lower(target) = s WHERE page_id <> dst),
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e),
d AS (SELECT p.page_id, count(x.id) AS degree FROM p LEFT JOIN (SELECT a AS id FROM u UNION ALL SELECT b FROM u) x ON x.id = p.page_id GROUP BY 1),
lim AS (SELECT avg(degree) + 2 * coalesce(stddev_samp(degree), 0) AS most FROM d),
i AS (SELECT dst AS page_id, count(*) AS n FROM e GROUP BY 1),
x AS (SELECT src AS page_id, count(*) AS n FROM e GROUP BY 1),
m AS (SELECT target, kind, count(DISTINCT page_id) AS n_pages, count(*) AS n_links FROM l WHERE lower(target) NOT IN (SELECT s FROM o) GROUP BY 1, 2)
SELECT 'node' AS part, kind, p.page_id AS key, stem AS name, coalesce(i.n, 0)::BIGINT AS n_in, coalesce(x.n, 0)::BIGINT AS n_out, degree::BIGINT AS degree,
  CASE WHEN degree > most THEN 'hub' WHEN stem IS NULL OR lower(stem) NOT IN (SELECT lower(target) FROM l) THEN 'orphan' ELSE 'page' END AS standing
FROM p JOIN d USING (page_id) LEFT JOIN i USING (page_id) LEFT JOIN x USING (page_id), lim
UNION ALL SELECT 'edge', kind, src, dst, NULL, NULL, NULL, NULL FROM e
UNION ALL SELECT 'broken', kind, NULL, target, n_pages::BIGINT, n_links::BIGINT, NULL, NULL FROM m
UNION ALL SELECT 'parsed', kind, page_id, address, NULL, len(t)::BIGINT, NULL, NULL FROM p
"""


@query(_LINKS_SQL)
def job2_link_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all four tables; of broken names ``n_in`` and ``n_out`` are the pages and the links."""
    top = shared_folder(spark, "job2")
    for _ in range(2):
        link_tables.run(spark, f"{sf_dir}/pages.parquet", f"{top}/out", _config(link_tables))
    read = lambda name: link_tables.table(spark, f"{top}/out", name)
    whole, word = F.lit(None).cast("long"), F.lit(None).cast("string")
    columns = ("part", "kind", "key", "name", "n_in", "n_out", "degree", "standing")
    parts = [
        read("nodes").select(F.lit("node"), "kind", "page_id", "stem", "n_in", "n_out", "degree", "standing"),
        read("edges").select(F.lit("edge"), "kind", "from", "to", whole, whole, whole, word),
        read("broken").select(F.lit("broken"), "kind", word, "target", "n_pages", "n_links", whole, word),
        read("parsed").select(F.lit("parsed"), "kind", "page_id", "address", whole, F.size("links").cast("long"), whole, word),
    ]
    out = parts[0].toDF(*columns)
    for part in parts[1:]:
        out = out.union(part.toDF(*columns))
    return out
