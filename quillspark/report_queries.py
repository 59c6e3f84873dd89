"""Registered queries of whole reports, each with all its parts in one table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import analyze, citations, graph, linktable, quality, relations
from .plans import render
from .queries import PAGES, QUERIES, SECTIONS, SQL, _sources, cte, query, view
from .session import shared_folder
from .sources.pagefiles import read_pages
from .wiki_queries import _ANSWERS_SQL, _FIGURES, FIGURES, LINKS, PAIRED, THESES, WORDS, _answers, wiki

# ---- the graph with ends that are no pages


_ENDS = """, u AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM (SELECT src AS s, dst AS t FROM e UNION SELECT page_id, "to" FROM i)),
ids AS (SELECT page_id AS id FROM w UNION SELECT a FROM u UNION SELECT b FROM u), d AS (SELECT id, count(v) AS degree FROM ids LEFT JOIN (SELECT a AS v FROM u UNION ALL SELECT b FROM u) ON v = id GROUP BY id),
m AS (SELECT (SELECT count(*) FROM w) AS n, (SELECT count(*) FROM u) AS m, count(*) AS ends, avg(degree) AS mean, stddev_samp(degree) AS sd, count(*) FILTER (degree = 0) AS orphans FROM d)"""


def _all_edges(spark, sf):
    return graph.undirected(graph.extracted_edges(wiki(spark, sf)).unionByName(graph.inferred_edges(*_answers(spark, sf))))


@query(
    LINKS + _ANSWERS_SQL + _ENDS + """ SELECT n::BIGINT AS n_nodes, m::BIGINT AS n_edges, round(m / n, 6) AS edges_per_node, round(2.0 * m / (ends * (ends - 1)), 9) AS density,
round(mean, 6) AS mean, round(sd, 6) AS sd, orphans::BIGINT AS orphans, CASE WHEN m / n >= 2 THEN 'healthy' WHEN m / n >= 1 THEN 'warning' ELSE 'critical' END AS band FROM m"""
)
def graph_health_with_absent_pages(spark, sf):
    """Inferred edges name pages that don't exist: they count as ends, not as pages."""
    pages, edges = wiki(spark, sf).select(F.col("page_id").alias("id")), _all_edges(spark, sf)
    s = graph.graph_stats(graph.degrees(pages, edges), edges, pages)
    r = lambda c, n=6: F.round(c, n).alias(c)
    return s.select("n_nodes", "n_edges", r("edges_per_node"), r("density", 9), r("mean"), r("sd"), "orphans", "band")


@query(LINKS + _ANSWERS_SQL + _ENDS + " SELECT id, degree::BIGINT AS degree FROM d WHERE degree > (SELECT mean + 2 * sd FROM m)")
def graph_hubs_with_absent_pages(spark, sf):
    """Hubs among all ends of edges."""
    return graph.god_nodes(graph.degrees(wiki(spark, sf).select(F.col("page_id").alias("id")), _all_edges(spark, sf)))


def _answer_tables(spark, sf):
    """Two answers of a third of the pages in a checkpoint, one of each page in a cache, half of it stale."""
    w = wiki(spark, sf)
    edge = lambda to, kind, confidence: F.array(F.struct(F.lit(to).alias("to"), F.lit(kind).cast("string").alias("type"), F.lit(confidence).cast("double").alias("confidence"), F.lit("r").alias("relationship")))
    third = w.where("c_custkey % 3 = 0")
    checkpoint = third.select("page_id", edge("sources/c-2", "AMBIGUOUS", 0.25).alias("edges"), F.lit("2").alias("ts")).union(third.select("page_id", edge("sources/c-1", None, None), F.lit("1")))
    hashes = w.select("page_id", "c_custkey", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    cache = hashes.select("page_id", F.when(F.col("c_custkey") % 2 == 0, F.col("sha256")).otherwise("old").alias("sha256"), edge("concepts/c-9", None, None).alias("edges"))
    return checkpoint, cache, hashes.select("page_id", "sha256")


@query(
    LINKS + """ SELECT page_id AS "from", CASE WHEN c_custkey % 3 = 0 THEN 'sources/c-2' ELSE 'concepts/c-9' END AS "to", CASE WHEN c_custkey % 3 = 0 THEN 'AMBIGUOUS' ELSE 'INFERRED' END AS type,
CASE WHEN c_custkey % 3 = 0 THEN 0.25 ELSE 0.7 END::DOUBLE AS confidence FROM w WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0"""
)
def wiki_latest_answers(spark, sf):
    """Edges of each page's last answer: the checkpoint before the cache, and of the cache what isn't stale."""
    return graph.answered_edges(graph.latest_answers(*_answer_tables(spark, sf))).drop("id")


@query(LINKS + " SELECT page_id FROM w WHERE c_custkey % 3 <> 0 AND c_custkey % 2 <> 0")
def wiki_unanswered_pages(spark, sf):
    """Pages without an answer in either."""
    checkpoint, cache, hashes = _answer_tables(spark, sf)
    return hashes.join(graph.latest_answers(checkpoint, cache, hashes), "page_id", "left_anti").select("page_id")


@query(
    LINKS + """, g AS (SELECT DISTINCT e.* FROM e JOIN w ON src = w.page_id WHERE w.kind = 'concepts'), p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(src) AS f, arg_min(dst, src) AS t FROM g GROUP BY 1, 2),
c AS (SELECT page_id AS id, c_nationkey AS community FROM w), x AS (SELECT f, t, ca.community AS ca, cb.community AS cb FROM p JOIN c ca ON f = ca.id JOIN c cb ON t = cb.id), out AS (SELECT ca AS community FROM x WHERE ca <> cb UNION SELECT cb FROM x WHERE ca <> cb)
SELECT 'phantom' AS "check", target AS page_id, count(DISTINCT page_id)::VARCHAR AS detail FROM l WHERE lower(target) NOT IN (SELECT lower(stem) FROM w) GROUP BY target HAVING count(DISTINCT page_id) >= 2
UNION ALL SELECT 'bridge', least(ca, cb) || '|' || greatest(ca, cb), min(f) || ' -> ' || min(t) FROM x WHERE ca <> cb GROUP BY least(ca, cb), greatest(ca, cb) HAVING count(*) = 1
UNION ALL SELECT 'isolated_community', community::VARCHAR, count(*)::VARCHAR FROM c WHERE community NOT IN (SELECT community FROM out) GROUP BY community HAVING count(*) >= 2"""
)
def wiki_graph_lint(spark, sf):
    """Phantoms, fragile bridges and isolated communities, of the links that concepts make, with nations as communities."""
    w = wiki(spark, sf)
    e = graph.undirected(graph.extracted_edges(w).join(w.where("kind = 'concepts'").select(F.col("page_id").alias("from")), "from", "left_semi").select("id", "from", "to", "type", "confidence"))
    return quality.graph_lint(w, relations.link_occurrences(w), e, w.select(F.col("page_id").alias("id"), F.col("c_nationkey").alias("community")))


# ---- coverage, cohorts, replication


def _tagged(w):
    return w.where("kind = 'sources'").withColumns({"methods": F.when(F.col("c_nationkey") % 2 == 0, F.array("segment")), "intervention_family": F.when(F.col("c_nationkey") % 3 == 0, F.col("segment"))})


_BARE = "(NOT contains(body, '## Used In This Wiki') OR NOT contains(string_split(body, '## Used In This Wiki')[-1], '[['))"


@query(
    LINKS + rf""", k AS (SELECT *, {WORDS} AS words FROM w), cd AS (SELECT CASE WHEN words < 500 THEN 'stub' WHEN words < 1500 THEN 'page' ELSE 'chapter' END AS depth, count(*) AS n FROM k WHERE kind = 'concepts' GROUP BY 1),
n AS (SELECT target AS slug, count(DISTINCT page_id) AS n FROM l WHERE kind = 'sources' AND page_id IN (SELECT page_id FROM w) GROUP BY 1), pr AS (SELECT slug, n, words FROM k JOIN n USING (slug) WHERE kind = 'concepts' AND words < 500 AND n >= 3 ORDER BY n DESC, slug DESC, words DESC LIMIT 20)
SELECT 'concepts by depth' AS section, depth AS item, n::VARCHAR AS value FROM cd UNION ALL SELECT 'share of concepts', depth, printf('%.1f', round(n * 100.0 / (SELECT sum(n) FROM cd), 1)) FROM cd
UNION ALL SELECT 'concepts to expand', slug, n || ' sources, ' || words || ' words' FROM pr UNION ALL SELECT 'sources without tags', slug, '' FROM w WHERE kind = 'sources' AND c_nationkey % 2 <> 0 AND c_nationkey % 3 <> 0
UNION ALL SELECT 'open questions', 'open', (count(*) FILTER (contains(lower(status), 'open')))::VARCHAR FROM w WHERE kind = 'questions' UNION ALL SELECT 'pages', kind, count(*)::VARCHAR FROM w GROUP BY kind
UNION ALL SELECT 'methods without use', page_id, words::VARCHAR FROM k WHERE kind = 'methods' AND {_BARE} UNION ALL SELECT 'interventions without use', page_id, words::VARCHAR FROM k WHERE kind = 'interventions' AND {_BARE}"""
)
def coverage_whole_report(spark, sf):
    """All sections of the coverage report."""
    w = wiki(spark, sf)
    return quality.coverage_report(w, _tagged(w))


_DESCRIPTORS = [("side", "left", r"\bthe\b"), ("side", "right", r"\bund\b"), ("phase", "acute", r"\bque\b"), ("phase", "none", r"\bno such word\b")]


@query(
    SECTIONS + r""", d(grp, label, p) AS (VALUES ('side', 'left', 'the'), ('side', 'right', 'und'), ('phase', 'acute', 'que'), ('phase', 'none', 'no such word')),
h AS (SELECT grp, label, count(DISTINCT slug) AS n FROM s JOIN d ON regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])' || p || '([^\p{L}\p{N}_]|$)') GROUP BY 1, 2)
SELECT 'all' AS section, 'sources' AS item, count(*)::VARCHAR AS value FROM s UNION ALL SELECT 'all', 'pooled', sum(year)::VARCHAR FROM s UNION ALL SELECT 'descriptors', d.grp || '/' || d.label, coalesce(n, 0)::VARCHAR FROM d LEFT JOIN h USING (grp, label)
UNION ALL SELECT 'severity', 'lowest', min(year) || '-' || min(year + 5) FROM s WHERE year % 2 = 0 UNION ALL SELECT 'severity', 'highest', max(year) || '-' || max(year + 5) FROM s WHERE year % 2 = 0 UNION ALL SELECT 'severity', 'reported', count(*)::VARCHAR FROM s WHERE year % 2 = 0
UNION ALL SELECT 'families', intervention_family, count(*) || ' sources, ' || sum(year) FROM s GROUP BY intervention_family"""
)
def cohort_whole_report(spark, sf):
    """All sections of the cohort report; severity ranges stand behind the texts of even years."""
    d = spark.createDataFrame(_DESCRIPTORS, "grp string, label string, pattern string")
    said = F.when(F.col("year") % 2 == 0, F.concat(F.lit(" score "), F.col("year").cast("string"), F.lit("-"), (F.col("year") + 5).cast("string"))).otherwise("")
    s = _sources(spark, sf).withColumn("told", F.concat(F.coalesce("text", F.lit("")), said))
    return analyze.cohort_report(s, d, "told", r"score (\d{4})-(\d{4})")


@query(
    cte(c=PAIRED) + r""", w AS (SELECT *, list_distinct(regexp_extract_all(population, '[\p{L}\p{N}_]{4,}')) AS w FROM c),
o AS (SELECT a.slug AS a, b.slug AS b, a.intervention_family AS family, len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) AS overlap FROM w a JOIN w b ON a.intervention_family = b.intervention_family AND a.study_design = b.study_design AND a.slug < b.slug WHERE a.replication_of <> b.doi AND b.replication_of <> a.doi)
SELECT 'replicated' AS section, x.slug AS a, c.slug AS b, '' AS detail FROM c JOIN c x ON c.replication_of = x.doi UNION ALL SELECT 'unknown original', slug, replication_of, '' FROM c WHERE replication_of <> '' AND replication_of NOT IN (SELECT doi FROM c)
UNION ALL SELECT 'single study', 'concept-' || slug, slug, '' FROM c WHERE slug LIKE '%7' UNION ALL SELECT 'candidate', a, b, family || ' ' || round(overlap, 2)::DOUBLE FROM o WHERE overlap >= 0.9"""
)
def replication_whole_report(spark, sf):
    """All sections of the replication report, every candidate."""
    s = view(spark, sf, PAIRED)
    link = F.concat(F.lit("[["), "slug", F.lit("]]"))
    body = F.concat(F.lit("## Empirical Evidence\n- "), link, F.when(F.col("slug").endswith("7"), F.lit("")).otherwise(F.lit(" and [[c-000001]] [[c-000002]]")), F.lit("\n## Next\n[[c-000003]]\n"))
    concepts = s.select(F.concat(F.lit("concept-"), "slug").alias("slug"), body.alias("body"))
    return analyze.replication_report(s, concepts, 0.9, None)


# ---- bibliography, audit, watch


_ENTRY = "'@article{' || slug || ',' || chr(10) || '  author   = {A One},' || chr(10) || '  title    = {' || c_name || '},' || chr(10) || '  journal  = {J}' || CASE WHEN c_nationkey % 4 > 0 THEN ',' || chr(10) || '  year     = {' || (1990 + c_nationkey) || '}' ELSE '' END || chr(10) || '}'"


@query(
    LINKS + f""", src AS (SELECT slug, CASE WHEN c_nationkey % 4 > 0 THEN 1990 + c_nationkey END AS year, {_ENTRY} AS entry FROM w WHERE kind = 'sources'),
t AS (SELECT 'chapters' AS mode, 'ch' || c_custkey % 10 AS label, target AS slug FROM s JOIN w USING (page_id) UNION SELECT w.kind, w.stem, target FROM s JOIN w USING (page_id) WHERE w.kind IN ('concepts', 'methods', 'interventions'))
SELECT mode, label, row_number() OVER (PARTITION BY mode, label ORDER BY coalesce(year, 9999), slug)::INT AS ord, count(*) OVER (PARTITION BY mode, label)::BIGINT AS n, entry FROM t JOIN src USING (slug)"""
)
def bibliography_groups(spark, sf):
    """Entries by concept, method and chapter, in the order of their files."""
    w, none = wiki(spark, sf), F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    fields = {"year": F.when(F.col("c_nationkey") % 4 > 0, 1990 + F.col("c_nationkey")).cast("int"), "title": F.col("c_name"), "journal": F.lit("J"), "bibtex_key": none, "authors": F.array(F.lit("A One")), "tags": empty, "source_pdf": none, "degree": none, "university": none, "doi": none, "intervention_family": F.lit("none"), "methods": empty, "domain": empty}
    chapters = w.select(F.concat(F.lit("ch"), (F.col("c_custkey") % 10).cast("string")).alias("chapter"), F.col("c_custkey").cast("int").alias("page_ord"), "page_id")
    return citations.bibtex_groups(w.where("kind = 'sources'").withColumns(fields), w, chapters)


@query(
    LINKS + r""" SELECT page_id, 8 AS first, CASE WHEN c_nationkey % 7 <> 0 THEN 10 + CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END ELSE length(content) - length(replace(content, chr(10), '')) END::INT AS last FROM w"""
)
def audit_section_lines(spark, sf):
    """Where a section stands in each page, by its name."""
    return analyze.section_lines(wiki(spark, sf), "Empirical Evidence")


@query(
    "WITH h AS (SELECT event_id, user_id FROM events), a AS (SELECT DISTINCT user_id FROM h WHERE user_id % 5 = 0), b AS (SELECT event_id, user_id FROM h WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM a)) "
    "SELECT 'new' AS part, user_id, count(*)::BIGINT AS n FROM b GROUP BY user_id UNION ALL SELECT 'seen', user_id, 1 FROM (SELECT user_id FROM a UNION SELECT user_id FROM b)"
)
def watch_remembered(spark, sf):
    """A watch's second run: new hits, and what it has seen then."""
    hits = view(spark, sf, ("events", ["event_id", "user_id"]))
    _, seen = citations.watched(hits.where("user_id % 5 = 0"), hits.select("user_id").limit(0), "user_id")
    new, seen = citations.watched(hits.where("event_id % 2 = 0"), seen, "user_id")
    rows = new.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit("new").alias("part"), "user_id", "n")
    return rows.union(seen.select(F.lit("seen"), "user_id", F.lit(1).cast("long")))


# ---- what is written


@query(
    cte(t=THESES) + """, c AS (SELECT page_id, (c_custkey % 5 + 1)::INT AS number, 'the-start' AS slug, 'The start' AS title, '# Chapter ' || (c_custkey % 5 + 1) || ': The start' || chr(10) || repeat('word ', 320) AS text FROM t
UNION ALL SELECT page_id, (c_custkey % 5 + 2)::INT, 'general-discussion', 'general discussion', '# **General Discussion**' || chr(10) || repeat('talk ', 310) FROM t UNION ALL SELECT page_id, 9, 'la-fin', 'La fin', '# Partie IX - La fin' || chr(10) || repeat('fin ', 400) FROM t)
SELECT page_id || '/ch' || lpad(number::VARCHAR, 2, '0') || '-' || slug || '.md' AS path, sha256('---' || chr(10) || 'chapter: ' || number || chr(10) || 'chapter_title: "' || title || '"' || chr(10) || 'parent_thesis: ' || page_id || chr(10) || 'type: source' || chr(10) || 'tags:' || chr(10) || '- thesis-chapter' || chr(10) || '---' || chr(10) || chr(10) || rtrim(text) || chr(10)) AS sha FROM c"""
)
def thesis_chapters_written(spark, sf):
    """A file for each chapter, with its own frontmatter, as it is read back."""
    root = shared_folder(spark, "chapters")
    render.write_files(render.chapter_files(relations.chapters(view(spark, sf, THESES))), root)
    return read_pages(spark, root).select("path", F.sha2("content", 256).alias("sha"))


@query(
    _FIGURES + """, x AS (SELECT page_id, image_id, CASE WHEN c_custkey % 3 > 0 THEN '- [[' || page_id || '--fig-' || (c_custkey % 9 + 1) || 'b' || CASE WHEN part <> '' THEN '-' || part ELSE '' END || '--shape-customer-' || lpad(c_custkey::VARCHAR, 9, '0') || '-curve]] ** The shape of the ' || c_name || ' curve' ELSE '- [[' || page_id || '--unlabelled]] ' END AS line FROM i)
SELECT page_id AS source, count(*)::BIGINT AS n, string_agg(line, chr(10) ORDER BY image_id) AS entries FROM x GROUP BY 1"""
)
def figure_index(spark, sf):
    """What the index page lists of each source's figures."""
    f = view(spark, sf, FIGURES)
    images = f.select("page_id", F.explode(F.regexp_extract_all("body", F.lit(r"img/([ab]\d+\.png)"), F.lit(1))).alias("image_id"))
    images = images.withColumns({"file": F.col("image_id"), "bytes": F.xxhash64("image_id")})
    return render.figure_index(relations.figure_bank(images, relations.figure_captions(f)))


@query(SQL["duplicates_by_text"])
def duplicates_written(spark, sf):
    """Candidates as JSON lines, as they are read back."""
    path = shared_folder(spark, "duplicates")
    found = QUERIES["duplicates_by_text"](spark, sf)
    render.write_duplicates(found.orderBy(F.desc("text_jaccard"), "a", "b"), path)
    return spark.read.schema(found.schema).json(path)


# ---- many analyses of one link table


_TABLES = cte(p=PAGES) + r""", l AS (SELECT page_id, unnest(regexp_extract_all(content, 'href="/([^"]+)"', 1)) AS target FROM p),
o AS (SELECT lower(stem) AS s, arg_max(page_id, path) AS owner FROM p WHERE stem IS NOT NULL GROUP BY 1),
m AS (SELECT * FROM l WHERE lower(target) NOT IN (SELECT s FROM o))
SELECT 'phantoms' AS section, target AS item, count(DISTINCT page_id)::BIGINT AS n FROM m GROUP BY target HAVING count(DISTINCT page_id) >= 2
UNION ALL SELECT 'missing', target, count(*)::BIGINT FROM m GROUP BY target HAVING count(*) >= 3
UNION ALL SELECT 'broken', page_id, count(*)::BIGINT FROM m GROUP BY page_id
UNION ALL SELECT 'unlinked', page_id, 0::BIGINT FROM p WHERE stem IS NULL OR lower(stem) NOT IN (SELECT lower(target) FROM l)
UNION ALL SELECT 'linked', owner, count(*)::BIGINT FROM o JOIN l ON lower(target) = s GROUP BY s, owner
UNION ALL SELECT 'total', 'broken', count(*)::BIGINT FROM m"""


@query(_TABLES)
def link_table_report(spark, sf):
    """Phantoms, missing entities, broken links, unlinked pages and links to each page, from names and targets that are bucketed alike."""
    found = F.regexp_extract_all("content", F.lit('href="/([^"]+)"'), F.lit(1))
    pages = view(spark, sf, PAGES).select("page_id", "path", "stem", found.alias("targets"))
    return linktable.link_report(linktable.store(pages, shared_folder(spark, "links")))
