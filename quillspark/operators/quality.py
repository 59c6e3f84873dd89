"""Structural health, lint checks of pages, and coverage."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Least words by study design, and the sections whose bullets need page references.
LEAST_WORDS = {"rct": 800, "cohort": 800, "cross-sectional": 800, "case-control": 800, "case-series": 600, "systematic-review": 1200, "meta-analysis": 1200, "scoping-review": 1000, "narrative-review": 800, "methodological": 600, "theoretical": 600}
CITED_SECTIONS = ("Key Findings", "Recommendations / Implications", "Background (from cited literature)", "Primary Outcome", "Secondary Outcomes")

FINDING = "struct<check: string, pass: boolean, severity: string, details: string>"


def stub_pages(pages: DataFrame, body: str = "body", least: int = 100) -> DataFrame:
    """(page_id, n_chars, status): bodies under the limit, empty or stub, shortest first."""
    n = F.length(F.btrim(F.coalesce(F.col(body), F.lit("")))).cast("long")
    return pages.select("page_id", n.alias("n_chars")).where(F.col("n_chars") < least).withColumn("status", F.when(F.col("n_chars") == 0, "empty").otherwise("stub")).orderBy("n_chars", "page_id")


def index_sync(index: DataFrame, pages: DataFrame, exempt: tuple[str, ...] = ("overview.md",)) -> DataFrame:
    """(href, problem): index links without a page, and pages that the index lacks."""
    listed = index.select("href").distinct()
    present = pages.select(F.col("path").alias("href")).where(~F.col("path").isin(*exempt))
    missing = listed.join(present, "href", "left_anti").withColumn("problem", F.lit("missing page"))
    return missing.unionByName(present.join(listed, "href", "left_anti").withColumn("problem", F.lit("not in index")))


def unlogged_sources(log: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources whose slug (dashes and underscores as blanks) and title are both no logged ingest title."""
    titles = log.where("op = 'ingest'").select(F.lower(F.btrim("title")).alias("t")).distinct()
    by_slug = sources.withColumn("t", F.lower(F.regexp_replace("slug", "[-_]", " "))).join(titles, "t", "left_anti").drop("t")
    return by_slug.withColumn("t", F.lower(F.btrim("title"))).join(titles, "t", "left_anti").select("slug")


def _finding(when: Column, check: str, severity: str, details: Column) -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(False).alias("pass"), F.lit(severity).alias("severity"), details.alias("details")))


def _dashes(body: Column) -> Column:
    c = X.dash_counts(body)
    return _finding((c.em + c.en) > 0, "em_dash", "WARNING", F.concat(c.em.cast("string"), F.lit(" em dashes, "), c.en.cast("string"), F.lit(" en dashes")))


def _findings(rows: DataFrame, found: list[Column], overall: str | None) -> DataFrame:
    """Explodes checks; with ``overall`` a page without findings gets one passing row."""
    all_ = F.array_compact(F.array(*found))
    if overall:
        passing = F.array(F.struct(F.lit(overall).alias("check"), F.lit(True).alias("pass"), F.lit("INFO").alias("severity"), F.lit("all deterministic checks pass").alias("details")))
        all_ = F.when(F.size(all_) > 0, all_).otherwise(passing)
    return rows.select(F.col("path").alias("file"), F.explode(all_).alias("f")).select("file", "f.check", "f.pass", "f.severity", "f.details")


def check_sources(sources: DataFrame) -> DataFrame:
    """Findings (file, check, pass, severity, details) of source pages with typed frontmatter and ``body``."""
    sources = sources.withColumns({"body": F.coalesce("body", F.lit("")), "_sections": X.sections(F.coalesce("body", F.lit("")))})
    body, sections = F.col("body"), F.col("_sections")
    thesis = F.coalesce(F.array_contains("tags", "thesis"), F.lit(False))
    blank = lambda c: ~X.truthy(F.btrim(F.col(c).cast("string")))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    unresolved = F.coalesce(F.size("cites_unresolved"), F.lit(0))
    bare = F.lit(0)
    for s in CITED_SECTIONS:
        lines = F.split(F.coalesce(X.section_of(sections, s), F.lit("")), "\n")
        bare = bare + F.size(F.filter(lines, lambda x: F.btrim(x).startswith("-") & (F.length(x) > 30) & ~x.rlike(X.PAGE_REF)))
    words = X.word_count(body)
    design = F.lower(F.coalesce("study_design", F.lit("")))
    least = F.coalesce(*(F.when(design == k, F.lit(v)) for k, v in LEAST_WORDS.items()))
    family = F.lower(F.coalesce("intervention_family", F.lit("")))
    checklist = F.coalesce(X.section_of(sections, "Extraction Checklist"), F.lit(""))
    unchecked, checked = F.regexp_count(checklist, F.lit(r"- \[ \]")), F.regexp_count(checklist, F.lit(r"- \[[xX]\]"))
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    found = [
        *(_finding(blank(c) if c != "authors" else empty(c), "frontmatter_required", "BLOCKING", F.lit(f"missing frontmatter: {c}")) for c in ("title", "authors", "date")),
        _finding(~thesis & blank("study_design"), "study_design_empty", "WARNING", F.lit("study_design: not set")),
        _finding(~thesis & blank("doi"), "doi_missing", "WARNING", F.lit("doi: empty")),
        _finding(empty("cites"), "cites_empty", "INFO", F.lit("cites: empty")),
        _finding(unresolved > 5, "cites_unresolved_high", "INFO", text(unresolved, " unresolved citations")),
        _finding(bare > 0, "uncited_claims", "BLOCKING", text(bare, " bullets miss `(p. ?)` in cited sections")),
        _finding(words < least * 0.5, "page_too_short", "WARNING", text(words, " words (expected ≥ ", least, " for ", design, ")")),
        _finding((family != "") & (family != "none") & F.col("path").contains("/articles/general/"), "wrong_folder", "WARNING", text("intervention_family=", family, " but file in articles/general/")),
        _finding(unchecked > (unchecked + checked) * 0.3, "checklist_incomplete", "BLOCKING", text(unchecked, "/", unchecked + checked, " checklist items unchecked")),
        _dashes(body),
    ]
    return _findings(sources, found, "source_page_overall")


def mentions(sources: DataFrame, body: str = "body") -> DataFrame:
    """(slug, n): sources whose body links a page by its exact slug."""
    return sources.select("page_id", F.explode(F.array_distinct(X.loose_links(F.col(body)))).alias("slug")).groupBy("slug").agg(F.count_distinct("page_id").alias("n"))


def check_concepts(concepts: DataFrame, mention_counts: DataFrame, least: int = 3) -> DataFrame:
    """Findings of concept pages: often named but short, and dashes."""
    rows = concepts.join(mention_counts, "slug", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    words = X.word_count(F.col("body"))
    details = F.concat(F.col("n").cast("string"), F.lit(" sources mention this concept but page is "), words.cast("string"), F.lit(" words (stub)"))
    return _findings(rows, [_finding((F.col("n") >= least) & (words < 500), "concept_stub_priority", "WARNING", details), _dashes(F.col("body"))], None)


def check_methods(methods: DataFrame) -> DataFrame:
    """Findings of method pages: links without a description, and dashes."""
    lines = F.split(F.coalesce(X.section(F.col("body"), "Used In This Wiki"), F.lit("")), "\n")
    bare = F.size(F.filter(lines, lambda x: F.btrim(x).startswith("- [[") & (F.length(F.btrim(x)) < 40)))
    details = F.concat(bare.cast("string"), F.lit(" bare wikilinks in `## Used In This Wiki` (no per-source description)"))
    return _findings(methods, [_finding(bare > 0, "method_bare_wikilinks", "WARNING", details), _dashes(F.col("body"))], None)


def lint(sources: DataFrame, concepts: DataFrame, methods: DataFrame, severity: str | None = None, prefix: str | None = None) -> DataFrame:
    """All deterministic checks, filtered by severity and path prefix."""
    out = check_sources(sources).union(check_concepts(concepts, mentions(sources))).union(check_methods(methods))
    if severity:
        out = out.where(F.col("severity") == severity)
    return out.where(F.col("file").startswith(prefix)) if prefix else out


def lint_summary(findings: DataFrame) -> DataFrame:
    """(severity, n, failed)."""
    return findings.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(~F.col("pass")).alias("failed"))


def health(pages: DataFrame, index: DataFrame, listed: DataFrame, log: DataFrame, sources: DataFrame, least: int = 100) -> DataFrame:
    """(check, item, detail): stubs, pages and index links without each other, and sources without an ingest entry."""
    row = lambda df, check, item, detail: df.select(F.lit(check).alias("check"), F.col(item).alias("item"), detail.alias("detail"))
    out = row(stub_pages(pages, least=least), "stub", "page_id", F.col("status"))
    out = out.union(row(index_sync(index, listed), "index", "href", F.col("problem")))
    return out.union(row(unlogged_sources(log, sources), "log", "slug", F.lit("no ingest entry")))


def structural_lint(pages: DataFrame, links: DataFrame, edges: DataFrame, entities: int = 3, sparse: int = 2, stub: int = 500, communities: DataFrame | None = None) -> DataFrame:
    """(check, page_id, detail): broken links, orphans, missing entities, pages with few links, and short hubs; with communities also what ``graph_lint`` finds."""
    from . import graph

    degree = graph.degrees(pages.select(F.col("page_id").alias("id")), edges)
    row = lambda df, check, item, detail: df.select(F.lit(check).alias("check"), F.col(item).alias("page_id"), detail.cast("string").alias("detail"))
    out = row(graph.broken_links(links, pages), "broken_link", "page_id", F.col("target"))
    out = out.union(row(graph.orphans(links, pages), "orphan", "page_id", F.lit("")))
    out = out.union(row(graph.missing_entities(links, pages, entities), "missing_entity", "target", F.col("mentions")))
    out = out.union(row(graph.sparse_pages(links, pages, sparse), "sparse", "page_id", F.col("outlinks")))
    out = out.union(row(graph.hub_stubs(degree, pages, stub), "hub_stub", "id", F.col("degree")))
    return out if communities is None else out.union(graph_lint(pages, links, edges, communities))


def graph_lint(pages: DataFrame, links: DataFrame, edges: DataFrame, communities: DataFrame, least: int = 2) -> DataFrame:
    """(check, page_id, detail): missing pages that several name, pairs of communities that one edge ties, and communities without an edge to another."""
    from . import graph

    row = lambda df, check, item, detail: df.select(F.lit(check).alias("check"), item.cast("string").alias("page_id"), detail.cast("string").alias("detail"))
    out = row(graph.phantom_hubs(links, pages, least), "phantom", F.col("target"), F.col("ref_count"))
    out = out.union(row(graph.fragile_bridges(edges, communities), "bridge", F.concat_ws("|", "low", "high"), F.concat_ws(" -> ", "from", "to")))
    return out.union(row(graph.isolated_communities(edges, communities), "isolated_community", F.col("community"), F.col("size")))


# caches


def cached_results(pages: DataFrame, cache: DataFrame, check: str, version: str) -> DataFrame:
    """Pages with their result in a cache (sha256, check, agent_version, pass, severity, details), null where it must run."""
    hit = cache.where((F.col("check") == check) & (F.col("agent_version") == version)).select("sha256", "pass", "severity", "details")
    return pages.join(hit, "sha256", "left")


def live_cache(cache: DataFrame, pages: DataFrame) -> DataFrame:
    """Cache rows whose path still exists."""
    return cache.join(pages.select("path").distinct(), "path", "left_semi")


def without_check(cache: DataFrame, check: str) -> DataFrame:
    """The cache with the results of one check forgotten."""
    return cache.where(F.col("check") != check)


def stale(current: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """(page_id, sha256): pages whose hash differs from the cache or is missing there."""
    old = cache.select("page_id", F.col("sha256").alias("_old"))
    rows = current.join(old, "page_id", "left")
    return (rows if force else rows.where("not (sha256 <=> _old)")).select("page_id", "sha256")


# coverage


def depth_distribution(pages: DataFrame) -> DataFrame:
    """(kind, depth, n, share): pages by depth class of their words."""
    rows = pages.groupBy("kind", X.depth_label(X.word_count(F.col("body"))).alias("depth")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("kind")), 1))


def priority_stubs(concepts: DataFrame, mention_counts: DataFrame, top: int = 20) -> DataFrame:
    """(slug, n, words): short concepts that three sources or more name."""
    rows = concepts.select("slug", X.word_count(F.col("body")).alias("words")).join(mention_counts, "slug")
    return rows.where("words < 500 and n >= 3").orderBy(F.desc("n"), F.desc("slug"), F.desc("words")).limit(top).select("slug", "n", "words")


def under_tagged(sources: DataFrame) -> DataFrame:
    """Sources without methods and without an intervention family."""
    return sources.where((F.coalesce(F.size("methods"), F.lit(0)) <= 0) & ~X.truthy(F.col("intervention_family"))).select("slug")


def bare_pages(pages: DataFrame, header: str = "## Used In This Wiki") -> DataFrame:
    """Pages without the section, or without a link behind it."""
    body = F.coalesce("body", F.lit(""))
    return pages.where(~body.contains(header) | ~F.substring_index(body, header, -1).contains("[[")).select("page_id")


def kind_counts(pages: DataFrame) -> DataFrame:
    """(kind, n, open_questions): open questions have a status that holds the word open, which is the default."""
    open_ = (F.col("kind") == "questions") & F.lower(F.coalesce("status", F.lit("open"))).contains("open")
    return pages.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(open_).alias("open_questions"))


def coverage(pages: DataFrame) -> DataFrame:
    """(section, item, value): pages by kind, depth classes, open questions, and methods that name no use."""
    row = lambda df, section, item, value: df.select(F.lit(section).alias("section"), item.alias("item"), value.cast("string").alias("value"))
    kinds = kind_counts(pages)
    out = row(kinds, "kinds", F.col("kind"), F.col("n"))
    out = out.union(row(depth_distribution(pages), "depth", F.concat_ws(" ", "kind", "depth"), F.col("n")))
    out = out.union(row(kinds.where("kind = 'questions'"), "open questions", F.col("kind"), F.col("open_questions")))
    return out.union(row(bare_pages(pages.where("kind = 'methods'")), "bare methods", F.col("page_id"), F.lit("")))


def coverage_report(pages: DataFrame, sources: DataFrame, top: int = 20) -> DataFrame:
    """(section, item, value): depth of concepts with shares, short concepts that many sources name (a report's ``top``), pages without recorded use, sources without tags, and counts by kind.

    ``pages`` are (page_id, slug, kind, body, status), ``sources`` have methods and
    intervention_family besides.
    """
    row = lambda df, section, item, value: df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("string").alias("value"))
    words = X.word_count(F.col("body"))
    concepts = pages.where("kind = 'concepts'")
    depth = depth_distribution(concepts)
    kinds = kind_counts(pages)
    parts = [
        row(depth, "concepts by depth", F.col("depth"), F.col("n")),
        row(depth, "share of concepts", F.col("depth"), F.format_number("share", 1)),
        row(priority_stubs(concepts, mentions(sources), top), "concepts to expand", F.col("slug"), F.concat_ws(" sources, ", "n", F.concat("words", F.lit(" words")))),
        row(under_tagged(sources), "sources without tags", F.col("slug"), F.lit("")),
        row(kinds.where("kind = 'questions'"), "open questions", F.lit("open"), F.col("open_questions")),
        row(kinds, "pages", F.col("kind"), F.col("n")),
    ]
    for kind in ("methods", "interventions"):
        own = pages.where(F.col("kind") == kind)
        parts.append(row(bare_pages(own).join(own.select("page_id", words.alias("w")), "page_id"), f"{kind} without use", F.col("page_id"), F.col("w")))
    return functools.reduce(DataFrame.union, parts)


def recent_sources(pages: DataFrame, top: int = 5) -> DataFrame:
    """The pages that changed last."""
    return pages.orderBy(F.desc("mtime"), "page_id").limit(top)


def consolidation_work(sources: DataFrame, concepts: DataFrame, most: int = 20, excerpt: int = 1500) -> DataFrame:
    """(concept, source, excerpt): the first pending sources of each concept (a work list's limit), with the start of their text."""
    rank = F.row_number().over(Window.partitionBy("concept").orderBy("source"))
    first = pending_consolidation(sources, concepts).withColumn("r", rank).where(F.col("r") <= most)
    texts = sources.select(F.col("slug").alias("source"), F.substring("body", 1, excerpt).alias("excerpt"))
    return first.join(texts, "source").select("concept", "source", "excerpt")


def pending_consolidation(sources: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, source): sources that name a concept whose page doesn't link back."""
    named = sources.select(F.col("slug").alias("source"), F.explode(F.array_distinct(X.loose_links(F.col("body")))).alias("concept"))
    back = concepts.select(F.col("slug").alias("concept"), F.explode(F.array_distinct(X.loose_links(F.col("body")))).alias("source"))
    return named.join(concepts.select(F.col("slug").alias("concept")), "concept", "left_semi").join(back, ["concept", "source"], "left_anti").select("concept", "source")
