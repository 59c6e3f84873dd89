"""Registered queries that go through files: vault scans, frontmatter, lexicons, snapshots, configuration and sinks.

Executors write the files out of the tables, into a new folder that all share, and read
them back; the SQL starts from the tables.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .plans import edits, render
from .queries import cte, query, view
from .session import shared_folder
from .sources import snapshots, vault
from .sources.config import chapter_pages, ingestible, watch_queries
from .sources.pagefiles import read_pages, write_pages


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "files")


# a page for each document: five kinds, special names, three forms of frontmatter
KINDS = ("sources", "concepts", "methods", "interventions", "entities")
SPECIAL = {0: "index", 1: "log", 2: "lint-report", 3: "health-report", 4: "overview", 5: "_draft", 6: ".hidden"}
_KIND = "case " + " ".join(f"when doc_id % 5 = {k} then '{v}'" for k, v in enumerate(KINDS)) + " end"
_STEM = "case " + " ".join(f"when doc_id = {k} then '{v}'" for k, v in SPECIAL.items()) + " when doc_id % 50 = 17 then concat('_page-', cast(doc_id as string)) else concat('Page-', cast(doc_id as string)) end"
_FENCE = (
    "case when doc_id % 4 = 3 then '' when doc_id % 4 = 2 then concat('---', chr(10), 'title: [broken', chr(10), '---', chr(10)) "
    "else concat('---', chr(10), 'title: \"', source, '\"', chr(10), 'rank: ', cast(doc_id as string), chr(10), '---', chr(10)) end"
)
VAULT = ("documents", ["doc_id", "source", f"{_KIND} as kind", f"{_STEM} as stem", f"concat({_KIND}, '/', {_STEM}, '.md') as path", f"{_FENCE} as fence", "coalesce(text, '') as text", f"concat({_FENCE}, coalesce(text, '')) as content"])
WROTE = cte(p=VAULT)


def _wiki(spark: SparkSession, sf: str) -> str:
    """The vault's pages, as files."""
    root = _folder(spark)
    write_pages(view(spark, sf, VAULT).select("path", "content"), root)
    return root


def _profile_sql() -> str:
    parts = []
    for name, (skipped, deep) in vault.PROFILES.items():
        if deep:
            over = vault.PASSED_OVER.get(name, "")
            names = ", ".join(map(repr, skipped)) or "''"
            parts.append(f"SELECT '{name}' AS profile, * FROM q WHERE stem NOT IN ({names}) AND stem[1] <> '{over}'")
    return " UNION ALL ".join(parts)


@query(WROTE + ", q AS (SELECT kind || '/' || stem AS page_id, kind, stem, sha256(content) AS sha256 FROM p) " + _profile_sql())
def vault_scans(spark, sf):
    root, out = _wiki(spark, sf), None
    for name, (_, deep) in vault.PROFILES.items():
        if deep:
            rows = vault.scan(spark, root, name).select(F.lit(name).alias("profile"), "page_id", "kind", "stem", "sha256")
            out = rows if out is None else out.union(rows)
    return out


@query(WROTE + " SELECT stem, doc_id % 4 <> 2 AS fm_ok, CASE WHEN doc_id % 4 < 2 THEN '{\"title\": \"' || source || '\", \"rank\": ' || doc_id || '}' END AS fm_json, sha256(CASE WHEN doc_id % 4 = 2 THEN content ELSE text END) AS body_sha FROM p WHERE kind = 'concepts'")
def vault_frontmatter(spark, sf):
    pages = vault.scan(spark, _wiki(spark, sf), "coverage", "concepts")
    return vault.frontmatter(pages).select("stem", "fm_ok", "fm_json", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha"))


@query(WROTE + " SELECT stem, source AS title, doc_id::VARCHAR AS rank FROM p WHERE doc_id % 4 < 2")
def vault_typed_fields(spark, sf):
    rows = vault.typed_sources(vault.frontmatter(vault.scan(spark, _wiki(spark, sf), "coverage"), "regex"))
    return rows.where("title is not null").select("stem", "title", F.try_variant_get("fm", "$.rank", "string").alias("rank"))


_ROOTS = ("customer", ["concat('r', cast(c_custkey as string)) as root", "c_custkey"])


@query("SELECT 'r' || c_custkey AS root, CASE WHEN c_custkey % 4 = 0 THEN 'legacy' WHEN c_custkey % 4 = 1 THEN 'single' WHEN c_custkey % 4 = 2 THEN 'ambiguous' ELSE 'empty' END AS mode, CASE WHEN c_custkey % 4 = 0 THEN 'z' WHEN c_custkey % 4 = 1 THEN 'a' WHEN c_custkey % 4 = 2 THEN 'a,b' ELSE '' END AS names FROM customer")
def vault_modes(spark, sf):
    """Roots of four kinds as files, listed and told apart."""
    made = "case when c_custkey % 4 = 0 then array('sources/x.md', 'z/sources/x.md') when c_custkey % 4 = 1 then array('a/sources/deep/x.md') when c_custkey % 4 = 2 then array('b/sources/x.md', 'a/sources/x.md') else array('a/papers/x.md', 'x.md') end"
    root = _folder(spark)
    files = view(spark, sf, _ROOTS).select("root", F.explode(F.expr(made)).alias("path"))
    write_pages(files.select(F.concat("root", F.lit("/"), "path").alias("path"), F.lit("text").alias("content")), root)
    at = F.instr("path", "/")
    listed = read_pages(spark, root).select(F.substring("path", F.lit(1), at - 1).alias("root"), F.substring("path", at + 1, F.length("path")).alias("path"))
    return vault.modes(listed).select("root", "mode", F.array_join("names", ",").alias("names"))


# ---- lexicons, of the part types


TYPES = ("part", ["p_type", "p_brand", "p_size"])
_NAMED = cte(p=TYPES) + ", t AS (SELECT DISTINCT p_type FROM p)"


def _lexicon(spark: SparkSession, rows: DataFrame, section: str) -> str:
    """A lexicon file of rows (first, key, value as JSON): one for each ``first``."""
    folder = _folder(spark)
    entry = F.concat(F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(": "), "value")
    body = F.array_join(F.sort_array(F.collect_list(entry)), ", ")
    files = rows.groupBy("first").agg(F.concat(F.lit(f'{{"other": {{}}, "{section}": {{'), body, F.lit("}}")).alias("content"))
    write_pages(files.select(F.concat("first", F.lit(".json")).alias("path"), "content"), folder)
    return folder


@query(_NAMED + " SELECT p_type AS key, 'the (' || p_type || ')' AS label, count(*)::BIGINT AS n FROM p WHERE length(p_type) % 3 <> 0 GROUP BY p_type")
def lexicon_matches(spark, sf):
    """A lexicon of aliases out of the part types, read back and found in a sentence of each part."""
    types = view(spark, sf, TYPES).select("p_type").distinct()
    note = F.when(F.length("p_type") % 3 == 0, F.lit("_")).otherwise(F.lit(""))
    value = F.to_json(F.struct(F.concat(F.lit("the ("), "p_type", F.lit(")")).alias("canonical"), F.array(F.concat(F.lit("x ("), "p_type", F.lit(") y")), F.concat(F.lit("a."), "p_type")).alias("aliases")))
    folder = _lexicon(spark, types.select(F.substring("p_type", 1, 1).alias("first"), F.concat(note, "p_type").alias("key"), value.alias("value")), "tracts")
    texts = view(spark, sf, TYPES).select(F.concat(F.lit("see A."), F.lower("p_type"), F.lit(" here")).alias("text"))
    lexicon = vault.lexicon_table(spark, folder, "tracts").union(vault.lexicon_table(spark, f"{folder}-none", "tracts"))
    hits = texts.join(F.broadcast(lexicon), F.rlike("text", F.concat(F.lit("(?iU)"), "pattern")))  # at most 150 part types
    return hits.groupBy("key", "label").agg(F.count("*").alias("n"))


@query("SELECT 'B' || right(p_brand, 2) AS key, count(*)::BIGINT AS n FROM part GROUP BY 1")
def lexicon_fragments(spark, sf):
    """A lexicon of raw fragments: the brands' numbers as patterns."""
    number = F.substring("p_brand", -2, 2)
    rows = view(spark, sf, TYPES).select("p_brand").distinct().select(F.lit("one").alias("first"), F.concat(F.lit("B"), number).alias("key"), F.to_json(F.array(F.lit("no match"), F.concat(F.lit("#"), number, F.lit("$")))).alias("value"))
    lexicon = vault.lexicon_table(spark, _lexicon(spark, rows, "scales"), "scales", "fragments")
    texts = view(spark, sf, TYPES).select(F.concat("p_brand", F.lit("#"), number).alias("text"))
    return texts.join(F.broadcast(lexicon), F.rlike("text", "pattern")).groupBy("key").agg(F.count("*").alias("n"))  # at most 25 brands


# ---- records and snapshots, of the customers

CUSTOMERS = ("customer", ["c_custkey as k", "c_nationkey as r", "c_name as name"])
_C = cte(c=CUSTOMERS)
_key = lambda mark, column="k": F.concat(F.lit(mark), F.col(column).cast("string"))


@query(_C + " SELECT 'n' || k AS page_id, 'to' || r AS \"to\", CASE WHEN k % 2 = 0 THEN 'AMBIGUOUS' ELSE 'INFERRED' END AS type, CASE WHEN k % 2 = 0 THEN 0.25 ELSE 0.7 END::DOUBLE AS confidence FROM c WHERE k % 5 < 4")
def checkpoint_edges(spark, sf):
    """Answers as JSON lines, every fifth of them broken."""
    c = view(spark, sf, CUSTOMERS)
    edge = F.struct(_key("to", "r").alias("to"), F.when(F.col("k") % 2 == 0, "AMBIGUOUS").alias("type"), F.when(F.col("k") % 2 == 0, 0.25).alias("confidence"))
    lost = F.struct(F.lit(None).cast("string").alias("to"), F.lit("no target").alias("type"), F.lit(None).cast("double").alias("confidence"))
    line = F.to_json(F.struct(_key("n").alias("page_id"), F.array(edge, lost).alias("edges")))
    folder = _folder(spark)
    c.select(F.when(F.col("k") % 5 == 4, "{broken").otherwise(line)).write.text(folder)
    return snapshots.inference_checkpoint(spark, folder).drop("relationship")


@query(_C + " SELECT 'n' || k AS page_id, 'r' || r AS \"to\", 'INFERRED' AS type, 0.7::DOUBLE AS confidence FROM c")
def checkpoint_appended(spark, sf):
    """A checkpoint that grows by a second writing."""
    folder = _folder(spark)
    edge = F.struct(_key("r", "r").alias("to"))
    rows = view(spark, sf, CUSTOMERS).select(_key("n").alias("page_id"), F.array(edge).alias("edges"), F.lit("t").alias("ts"), "k")
    for part in ("k % 2 = 0", "k % 2 <> 0"):
        render.append_checkpoint(rows.where(part).drop("k"), folder)
    return snapshots.inference_checkpoint(spark, folder).drop("relationship")


@query(_C + " SELECT '10.1/n' || k AS doi, name AS title FROM c WHERE k % 4 > 0")
def titles_expected(spark, sf):
    """A CSV file with a header; rows without a DOI are passed over."""
    folder = _folder(spark)
    doi = F.when(F.col("k") % 4 > 0, F.concat(F.lit("https://doi.org/10.1/N"), F.col("k").cast("string"), F.lit("."))).otherwise("")
    view(spark, sf, CUSTOMERS).select(F.col("name").alias("Title"), doi.alias("DOI"), F.lit("x, y").alias("Note")).write.option("header", "true").csv(folder)
    return snapshots.expected_titles(spark, folder)


def _books(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, content) of EPUB files for (k, name), a thousand to a folder."""
    space = 'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"'
    for part in rows:
        out = []
        for k, name in zip(part["k"].tolist(), part["name"], strict=True):
            role, scheme = ("edt" if k % 2 else "aut"), ("ISBN" if k % 3 == 0 else "UUID")
            body = (
                f'<package {space}><dc:title> {name} </dc:title><dc:creator opf:role="{role}">{name} A</dc:creator><dc:language>EN-gb</dc:language>'
                f'<dc:identifier>0123456789012</dc:identifier><dc:identifier opf:scheme="{scheme}">978-3-16-14841-{k % 100:02d}</dc:identifier><dc:date>in {1990 + k % 30}-01</dc:date></package>'
            )
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                z.writestr("x/content.opf", body)
            out.append((f"{k // 1000}/{k}.epub", data.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


@query(_C + " SELECT k, name AS title, CASE WHEN k % 2 = 0 THEN name || ' A' ELSE '' END AS authors, CASE WHEN k % 2 = 1 THEN name || ' A' ELSE '' END AS editors, CASE WHEN k % 3 = 0 THEN '97831614841' || lpad((k % 100)::VARCHAR, 2, '0') END AS isbn, 'en' AS language, (1990 + k % 30)::INT AS year FROM c")
def epub_fields(spark, sf):
    """A book for each customer."""
    folder = _folder(spark)
    write_pages(view(spark, sf, CUSTOMERS).select("k", "name").mapInPandas(_books, "path string, content binary"), folder)
    rows = vault.epubs(spark, folder)
    key = F.regexp_extract("path", r"(\d+)\.epub$", 1).cast("long")
    return rows.select(key.alias("k"), "title", F.array_join("authors", ",").alias("authors"), F.array_join("editors", ",").alias("editors"), "isbn", "language", "year")


@query(_C + " SELECT 'node' AS part, 'n' || k AS id, name AS label FROM c UNION ALL SELECT 'edge', 'n' || k, 'r' || r FROM c")
def graph_written(spark, sf):
    """Nodes and edges as JSON lines."""
    folder, c = _folder(spark), view(spark, sf, CUSTOMERS)
    render.write_graph(c.select(_key("n").alias("id"), F.col("name").alias("label")), c.select(_key("n").alias("from"), _key("r", "r").alias("to")), folder)
    nodes, edges_ = spark.read.json(f"{folder}/nodes"), spark.read.json(f"{folder}/edges")
    return nodes.select(F.lit("node").alias("part"), "id", "label").union(edges_.select(F.lit("edge"), "from", "to"))


@query(_C + " SELECT 'n' || k AS id, 'r' || r AS \"to\" FROM c")
def graph_snapshot_edges(spark, sf):
    """Graphs of up to a hundred nodes, a JSON document each, up to a hundred of them in the array of a file."""
    folder = _folder(spark)
    node, edge = F.struct(_key("n").alias("id")), F.struct(_key("n").alias("id"), _key("r", "r").alias("to"))
    docs = view(spark, sf, CUSTOMERS).groupBy(F.floor(F.col("k") / 100).alias("g")).agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))
    docs = docs.select(F.floor(F.col("g") / 100).alias("pack"), F.to_json(F.struct("nodes", "edges", F.lit("x").alias("built"))).alias("value"))
    packs = docs.groupBy("pack").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    packs.write.partitionBy("pack").text(folder)
    _, edges_ = snapshots.graph_snapshot(spark, folder)
    return edges_.select("id", "to")


@query(_C + " SELECT '10.1/' || k AS doi, name AS title, CASE WHEN k % 2 = 0 THEN '2001' END AS year, k % 3 = 0 AS valid FROM c WHERE k % 6 < 5")
def snapshot_tables(spark, sf):
    """Metadata and validation snapshots with faulty lines, joined."""
    folder, c = _folder(spark), view(spark, sf, CUSTOMERS)
    meta = F.to_json(F.struct(_key("10.1/").alias("doi"), F.col("name").alias("title"), F.lit(1).alias("more"), F.when(F.col("k") % 2 == 0, "2001").alias("year")))
    c.select(F.when(F.col("k") % 6 < 5, meta).otherwise("{oops")).write.text(f"{folder}/meta")
    c.select(F.to_json(F.struct(_key("10.1/").alias("doi"), (F.col("k") % 3 == 0).alias("valid")))).write.text(f"{folder}/valid")
    read = lambda name, part: snapshots.snapshot(spark, name, f"{folder}/{part}")
    return read("doi_metadata", "meta").join(read("doi_validation", "valid"), "doi").select("doi", "title", "year", "valid")


def _each_schema(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Rows of four snapshot tables, out of the customers."""
    c = view(spark, sf, CUSTOMERS)
    doi, names = _key("10.1/").alias("doi"), F.array("name", _key("B")).alias("authors")
    year = (F.lit(1990) + F.col("k") % 30).cast("int").alias("year")
    return {
        "forward_citers": c.select(_key("10.9/", "r").alias("source_doi"), F.lit(2000).alias("since_year"), doi, F.col("name").alias("title"), names, year, F.lit("V").alias("venue"), F.col("k").cast("int").alias("venue_h"), F.lit(3).alias("citations")),
        "pubmed_hits": c.select(_key("q", "r").alias("query_name"), _key("").alias("pmid"), F.col("name").alias("title"), names, F.lit("J").alias("journal"), year.cast("string").alias("year"), doi),
        "conversion_report": c.select(F.array(F.struct(_key("p").alias("pdf"), F.col("k").cast("long").alias("chars"), F.lit(0.5).alias("sec"))).alias("ok"), F.array(_key("s")).alias("skipped"), F.array(F.struct(_key("e").alias("pdf"), F.lit("bad").alias("error"))).alias("errors")),
        "lint_cache": c.select(F.sha2("name", 256).alias("sha256"), _key("p").alias("path"), F.lit("dash").alias("check"), F.lit("1").alias("agent_version"), (F.col("k") % 2 == 0).alias("pass"), F.lit("low").alias("severity"), F.col("name").alias("details")),
    }


@query(
    _C + """ SELECT 'forward_citers' AS name, '10.1/' || k AS key, name || '|B' || k || '|' || (1990 + k % 30) || '|' || k AS told FROM c WHERE k % 7 > 0
    UNION ALL SELECT 'pubmed_hits', k::VARCHAR, name || '|B' || k || '|' || (1990 + k % 30) || '|q' || r FROM c WHERE k % 7 > 0
    UNION ALL SELECT 'conversion_report', 'p' || k, k || '|s' || k || '|e' || k || '|bad' FROM c WHERE k % 7 > 0
    UNION ALL SELECT 'lint_cache', 'p' || k, name || '|' || (k % 2 = 0) || '|low|' || sha256(name) FROM c WHERE k % 7 > 0
    UNION ALL SELECT n || ' faulty', NULL, '{"k": ' || k || ', broken' FROM c, (SELECT unnest(['forward_citers', 'pubmed_hits', 'conversion_report', 'lint_cache']) AS n) WHERE k % 7 = 0"""
)
def snapshot_schemas(spark, sf):
    """Four more snapshot tables with their arrays, and the lines of each that are faulty."""
    folder, out = _folder(spark), None
    bad = view(spark, sf, CUSTOMERS).where("k % 7 = 0").select(F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit(", broken")).alias("value"))
    told = {
        "forward_citers": ("doi", ["title", F.get("authors", 1), F.col("year").cast("string"), F.col("venue_h").cast("string")]),
        "pubmed_hits": ("pmid", ["title", F.get("authors", 1), "year", "query_name"]),
        "conversion_report": (F.get("ok.pdf", 0), [F.get("ok.chars", 0).cast("string"), F.get("skipped", 0), F.get("errors.pdf", 0), F.get("errors.error", 0)]),
        "lint_cache": ("path", ["details", F.col("pass").cast("string"), "severity", "sha256"]),
    }
    good = view(spark, sf, CUSTOMERS).where("k % 7 > 0")
    for name, rows in _each_schema(spark, sf).items():
        rows.select(F.to_json(F.struct("*")).alias("value")).union(bad).write.text(f"{folder}/{name}")
        key, parts = told[name]
        read = snapshots.snapshot(spark, name, f"{folder}/{name}").select(F.lit(name).alias("name"), key if isinstance(key, str) else key.alias("key"), F.concat_ws("|", *parts).alias("told")).toDF("name", "key", "told")
        broken = snapshots.faulty(spark, name, f"{folder}/{name}").select(F.lit(f"{name} faulty"), F.lit(None).cast("string"), "corrupt")
        out = read.union(broken) if out is None else out.union(read).union(broken)
    known = good.select(F.explode(F.array(_key("10.1/"), _key(""), _key("p"))).alias("key")).distinct()
    return out.join(known, "key", "left_semi").union(out.where("key is null").select("key", "name", "told")).select("name", "key", "told")


@query(_C + " SELECT 'r' || r AS label, '@article{' || name || '}' AS entry FROM c")
def bibliography_written(spark, sf):
    """Entries as text in a folder for each label."""
    folder = _folder(spark)
    rows = view(spark, sf, CUSTOMERS).select(F.lit("concept").alias("category"), _key("r", "r").alias("label"), F.concat(F.lit("@article{"), "name", F.lit("}")).alias("entry"))
    render.write_bibliography(rows, folder, by_label=True)
    return spark.read.text(folder).where("value <> ''").select("label", F.col("value").alias("entry"))


# ---- pages that change


_INDEX = "'# Index' || chr(10) || CASE WHEN k % 3 = 0 THEN '## Sources' || chr(10) || '- old' || chr(10) ELSE '' END || CASE WHEN k % 3 = 1 THEN '## Other' || chr(10) || chr(10) || ' ' ELSE '' END"


@query(_C + ", i AS (SELECT 'v' || k || '/index' AS page_id, '- ' || name AS e, k FROM c) SELECT page_id, CASE k % 3 WHEN 0 THEN '# Index' || chr(10) || '## Sources' || chr(10) || e || chr(10) || '- old' || chr(10) WHEN 1 THEN '# Index' || chr(10) || '## Other' || chr(10) || chr(10) || '## Sources' || chr(10) || e || chr(10) ELSE '# Index' || chr(10) || chr(10) || '## Sources' || chr(10) || e || chr(10) END AS content FROM i UNION ALL SELECT 'v' || k || '/log', '## [2024-01-01] ingest | ' || name || chr(10) FROM c")
def index_and_log_entries(spark, sf):
    """An index and a log for each customer: written, planned, applied and read back."""
    root = _folder(spark)
    c = view(spark, sf, CUSTOMERS).withColumn("content", F.expr(_INDEX))
    path = F.concat(_key("v"), F.lit("/index.md"))
    write_pages(c.select(path.alias("path"), "content"), root)
    now = read_pages(spark, root).where("stem = 'index'")
    new = now.join(c.select(path.alias("path"), "name"), "path").select("path", F.sha2("content", 256).alias("old_sha"), render.with_index_entry(F.col("content"), F.concat(F.lit("- "), "name"), "Sources").alias("new_content"))
    edits.apply(root, new)
    line = render.log_entry(F.lit("2024-01-01"), F.lit("ingest"), F.col("name"))
    write_pages(c.select(F.concat(_key("v"), F.lit("/log.md")).alias("path"), line.alias("content")), root)
    return read_pages(spark, root).select(F.regexp_replace("path", r"\.md$", "").alias("page_id"), "content")


_PATCHED = ("documents", ["doc_id", "concat('p', cast(doc_id as string)) as slug", "coalesce(text, '') as text"])


@query(
    cte(d=_PATCHED) + """, q AS (SELECT doc_id, slug, '---' || chr(10) || 'title: T' || doc_id || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'cites:' || chr(10) || '- 10.1/' || doc_id || chr(10) ELSE '' END || 'year: 2000' || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN 'cites_curated:' || chr(10) || '- x' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || ltrim(text, chr(10)) AS c FROM d)
    SELECT CASE WHEN doc_id % 5 = 1 THEN 'moved/' ELSE '' END || slug AS page, sha256(c) AS sha FROM q WHERE doc_id % 5 <> 0"""
)
def patched_pages(spark, sf):
    """A page for each document: written by executors, patched, some moved, some deleted, and the whole plan applied once more; the vault as it is read back."""
    root = _folder(spark)
    d = view(spark, sf, _PATCHED)
    head = F.concat(F.lit("---\ntitle: T"), F.col("doc_id").cast("string"), F.lit("\ncites: [old]\nyear: 2000\n---\n"))
    write_pages(d.select(F.concat("slug", F.lit(".md")).alias("path"), F.concat(head, "text").alias("content")), root)
    pages = vault.scan(spark, root, "coverage")
    patch = lambda f, some, value: d.select("slug", F.lit(f).alias("field"), F.when(some, F.array(value)).alias("value"))
    patches = patch("cites", F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).union(patch("cites_curated", F.col("doc_id") % 3 == 0, F.lit("x")))
    # a plan is kept as a table: it is worked out before the pages change
    plans = {"edits": edits.patch_edits(pages, patches).select("path", "old_sha", "new_content")}
    plans["moves"] = d.where("doc_id % 5 = 1").select(F.concat("slug", F.lit(".md")).alias("from"), F.concat(F.lit("moved/"), "slug", F.lit(".md")).alias("to"))
    plans["deletes"] = d.where("doc_id % 5 = 0").select(F.concat("slug", F.lit(".md")).alias("path"))
    where = _folder(spark)
    for name, plan in plans.items():
        plan.write.parquet(f"{where}/{name}")
    read = {name: spark.read.schema(plan.schema).parquet(f"{where}/{name}") for name, plan in plans.items()}
    edits.apply(root, **read)
    edits.apply(root, moves=read["moves"], deletes=read["deletes"])
    return read_pages(spark, root).select(F.regexp_replace("path", r"\.md$", "").alias("page"), F.sha2("content", 256).alias("sha"))


@query(_C + " SELECT 'r' || r AS id, count(*)::BIGINT AS degree FROM c GROUP BY 1 UNION ALL SELECT 'n' || k, 1 FROM c")
def vault_link_degrees(spark, sf):
    """Links written into files, scanned, resolved and counted."""
    root, c = _folder(spark), view(spark, sf, CUSTOMERS)
    link = F.concat(F.lit("[["), _key("R", "r"), F.lit("]]"))
    sources = c.select(F.concat(F.lit("sources/"), _key("n"), F.lit(".md")).alias("path"), F.concat(F.lit("See "), link, F.lit(" and "), link, F.lit(".")).alias("content"))
    concepts = c.select("r").distinct().select(F.concat(F.lit("concepts/"), _key("r", "r"), F.lit(".md")), F.lit("Nothing."))
    write_pages(sources.union(concepts), root)
    pages = vault.scan(spark, root, "graph")
    e = graph.undirected(graph.extracted_edges(pages))
    ids = pages.select(F.col("page_id").alias("id"))
    return graph.degrees(ids, e).select(F.element_at(F.split("id", "/"), -1).alias("id"), "degree")


# ---- configuration


_FILES = ", g AS (SELECT k // 50 AS f, k, name, row_number() OVER (PARTITION BY k // 50 ORDER BY k) - 1 AS i FROM c)"


def _yaml_files(spark: SparkSession, sf: str, head: str, entry) -> str:
    """YAML files of up to fifty entries each, in order of the key."""
    folder = _folder(spark)
    files = view(spark, sf, CUSTOMERS).groupBy(F.floor(F.col("k") / 50).alias("f")).agg(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))).alias("e"))
    write_pages(files.select(_key("", "f").alias("path"), F.concat(F.lit(head), F.array_join(F.transform("e", lambda x: x.e), "")).alias("content")), folder)
    return folder


@query(_C + _FILES + ", x AS (SELECT k, unnest(CASE WHEN k % 3 = 0 THEN [0, 1] WHEN k % 3 = 1 THEN [0] ELSE [] END) AS o FROM g) SELECT 'the-r' || k AS chapter, o::INT AS page_ord, CASE WHEN o = 0 THEN 'p' || k ELSE '12' END AS page_id FROM x")
def chapter_list(spark, sf):
    """Chapter lists in several files; a chapter may have no pages."""
    pages = F.when(F.col("k") % 3 == 0, F.concat(F.lit("\n  pages: ["), _key("p"), F.lit(", 12]\n"))).when(F.col("k") % 3 == 1, F.concat(F.lit("\n  pages:\n  - "), _key("p"), F.lit("\n"))).otherwise("\n")
    entry = F.concat(F.lit("- name: 'The R"), F.col("k").cast("string"), F.lit("!'"), pages)
    return chapter_pages(spark, _yaml_files(spark, sf, "chapters:\n", entry))


@query(_C + _FILES + " SELECT i::INT AS ord, CASE WHEN k % 3 = 0 THEN 'query ' || k ELSE name END AS name, 'query ' || k AS query FROM g WHERE k % 4 > 0")
def watch_list(spark, sf):
    """Watch lists with odd entries: no name, no query, no mapping."""
    k = F.col("k").cast("string")
    named = F.concat(F.lit("- {name: '"), "name", F.lit("', pubmed: 'query "), k, F.lit("'}\n"))
    entry = F.when(F.col("k") % 8 == 0, "- odd\n").when(F.col("k") % 4 == 0, "- {name: none}\n").when(F.col("k") % 3 == 0, F.concat(F.lit("- pubmed: query "), k, F.lit("\n"))).otherwise(named)
    return watch_queries(spark, _yaml_files(spark, sf, "queries:\n", entry))


@query(_C + " SELECT k, k % 4 < 2 AS ok FROM c")
def files_ingestible(spark, sf):
    """Endings of file names, in any case."""
    ending = F.element_at(F.array(*map(F.lit, (".PDF", ".ipynb", ".exe", "pdf"))), (F.col("k") % 4 + 1).cast("int"))
    return view(spark, sf, CUSTOMERS).select("k", ingestible(F.concat(F.lit("a.b/"), "name", ending)).alias("ok"))
