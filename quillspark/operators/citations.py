"""Citation networks: reverse citations, reading suggestions, bibliography export, open-access choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def doi_owner(sources: DataFrame) -> DataFrame:
    """(doi, slug): the source with a DOI; of several the last slug."""
    return sources.select(F.lower(F.btrim("doi")).alias("doi"), "slug").where("doi <> ''").groupBy("doi").agg(F.max("slug").alias("slug"))


def cited_by(cites: DataFrame, sources: DataFrame, distinct: bool = False) -> DataFrame:
    """(slug, cited_by): sorted slugs that cite a source; itself left out, repeats kept unless ``distinct``."""
    owned = cites.select(F.col("slug").alias("citer"), "doi").join(doi_owner(sources), "doi").where("citer <> slug")
    gather = F.collect_set("citer") if distinct else F.collect_list("citer")
    return owned.groupBy("slug").agg(F.sort_array(gather).alias("cited_by"))


def snowball(cites: DataFrame, sources: DataFrame, top: int | None = 30) -> DataFrame:
    """(doi, n, citers): cited DOIs that no source has, by count."""
    fresh = cites.join(doi_owner(sources).select("doi"), "doi", "left_anti")
    best = fresh.groupBy("doi").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doi")
    if top:  # citers are gathered for these alone
        best = best.limit(top)
        fresh = fresh.join(F.broadcast(best.select("doi")), "doi", "left_semi")
    return best.join(fresh.groupBy("doi").agg(F.sort_array(F.collect_list("slug")).alias("citers")), "doi").orderBy(F.desc("n"), "doi")


def snowball_by_concept(cites: DataFrame, sources: DataFrame, named: DataFrame, top: int = 30) -> DataFrame:
    """(concept, doi, n, citers): as ``snowball``, over the sources that name each concept (concept, slug); the first ``top`` of a concept (a report's limit)."""
    fresh = cites.join(doi_owner(sources).select("doi"), "doi", "left_anti").join(named, "slug")
    counted = fresh.groupBy("concept", "doi").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("n"), "doi"))
    best = counted.withColumn("r", rank).where(F.col("r") <= top).drop("r")
    # citers are gathered for the rows that stay alone
    citers = fresh.join(best.select("concept", "doi"), ["concept", "doi"], "left_semi").groupBy("concept", "doi").agg(F.sort_array(F.collect_list("slug")).alias("citers"))
    return best.join(citers, ["concept", "doi"]).orderBy("concept", F.desc("n"), "doi")


def forward_candidates(citers: DataFrame, sources: DataFrame, as_of: int, **limits: float) -> DataFrame:
    """Ranked works that cite sources, from (source_doi, doi, title, year, venue, venue_h, citations): not in the wiki, passing the filter."""
    fresh = citers.withColumn("doi", F.lower(F.btrim("doi"))).where("doi <> ''").join(doi_owner(sources).select("doi"), "doi", "left_anti")
    seen = fresh.groupBy("doi").agg(F.count_distinct("source_doi").alias("co"), *(F.min_by(c, "source_doi").alias(c) for c in ("title", "year", "venue", "venue_h", "citations")))
    vel = X.velocity(F.col("citations"), F.col("year"), as_of)
    rows = seen.withColumn("velocity", vel)
    rows = rows.where(X.forward_passes(F.col("co"), F.col("velocity"), F.col("year"), F.col("venue_h"), as_of, **limits))
    return rows.withColumn("score", X.composite_score(F.col("co"), F.col("velocity"), F.col("venue_h"))).orderBy(F.desc("score"), F.desc("year"), "doi")


def unseen(hits: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """New hits and nothing that the seen table holds."""
    return hits.join(seen.select(key), key, "left_anti")


def watched(hits: DataFrame, seen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new hits, seen table after them): the seen table grows by what is new, each key once."""
    new = unseen(hits, seen, key)
    return new, seen.select(key).union(new.select(key)).where(F.col(key).isNotNull()).distinct()


def contains_all_words(blob: Column, query: str, least: int = 4) -> Column:
    """Whether a text has every query word of at least so many letters."""
    words = [w for w in query.lower().split() if len(w) >= least]
    return F.forall(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"), lambda w: F.lower(blob).contains(w))


# bibliography


def bibtex_entries(sources: DataFrame) -> DataFrame:
    """(category, label, year, slug, entry) of every source."""
    fm = {"key": F.col("bibtex_key"), "title": F.col("title"), "authors": F.col("authors"), "tags": F.col("tags"), "degree": F.col("degree"), "university": F.col("university"), "journal": F.col("journal"), "year": F.col("year"), "doi": F.col("doi"), "pdf": F.col("source_pdf")}
    kind = X.primary_type(F.col("intervention_family"), F.col("methods"), F.col("domain"))
    return sources.select(kind.alias("k"), "year", "slug", X.bibtex(F.col("slug"), fm).alias("entry")).select("k.category", "k.label", "year", "slug", "entry")


def bibtex_master(sources: DataFrame) -> DataFrame:
    """(ord, chunk): group headers and their entries in file order; entries by year, those without one last, and of one slug by themselves, so that the order is always the same."""
    rows = bibtex_entries(sources)
    own = Window.partitionBy("category", "label").orderBy(F.coalesce("year", F.lit(9999)), "slug", "entry")
    rows = rows.withColumn("k", F.row_number().over(own))
    rule = "% " + "=" * 60
    head = F.concat(F.lit(f"{rule}\n% "), F.upper("category"), F.lit(": "), F.col("label"), F.lit(f"\n{rule}\n\n"))
    return rows.select("category", "label", "k", F.concat(F.when(F.col("k") == 1, head).otherwise(""), "entry").alias("chunk")).orderBy("category", "label", "k")


def sources_by_target(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(page_id, slug): sources that a page names by strict links, once each."""
    return links.select("page_id", F.col("target").alias("slug")).join(sources.select("slug"), "slug").select("page_id", "slug").distinct()


def chapter_sources(chapters: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """(chapter, ord, slug): sources in order of first appearance over a chapter's pages (chapter, page_ord, page_id)."""
    hits = chapters.join(links, "page_id").select("chapter", F.struct("page_ord", "pos").alias("at"), F.col("target").alias("slug")).join(sources.select("slug"), "slug")
    first = hits.groupBy("chapter", "slug").agg(F.min("at").alias("at"))
    return first.select("chapter", F.row_number().over(Window.partitionBy("chapter").orderBy("at")).alias("ord"), "slug")


def bibtex_groups(sources: DataFrame, pages: DataFrame, chapters: DataFrame | None = None, kinds: tuple[str, ...] = ("concepts", "interventions", "methods")) -> DataFrame:
    """(mode, label, ord, n, entry): the entries of the sources that a page of a kind names, or the pages of a chapter, by year and slug; n is their number.

    ``pages`` are (page_id, kind, stem, content), ``chapters`` (chapter, page_ord, page_id).
    """
    from .relations import link_occurrences

    links = link_occurrences(pages, grammar="strict")
    own = pages.where(F.col("kind").isin(*kinds)).select("page_id", F.col("kind").alias("mode"), F.col("stem").alias("label"))
    rows = sources_by_target(links, sources).join(own, "page_id").select("mode", "label", "slug")
    if chapters is not None:
        rows = rows.union(chapter_sources(chapters, links, sources).select(F.lit("chapters"), "chapter", "slug"))
    entries = bibtex_entries(sources).select("slug", "year", "entry")
    group = Window.partitionBy("mode", "label")
    rows = rows.distinct().join(entries, "slug").withColumns({"ord": F.row_number().over(group.orderBy(F.coalesce("year", F.lit(9999)), "slug")), "n": F.count("*").over(group)})
    return rows.select("mode", "label", "ord", "n", "entry")


# fetching: choices over snapshots of attempts


def best_version(attempts: DataFrame, enough: int = 2) -> DataFrame:
    """(doi, provider, url, version, rank, final): from verified attempts (doi, provider_ord, cand_ord, provider, url, version, verified).

    The first provider's first candidate of rank ``enough`` or more wins; without
    one, the earliest of the highest rank is provisional.
    """
    rows = attempts.where("verified").withColumn("rank", X.version_rank(F.col("version")))
    at = F.struct("provider_ord", (-F.col("rank")).alias("r"), "cand_ord", "url")
    row = F.struct("provider", "url", "version", "rank")
    good = F.min_by(F.when(F.col("rank") >= enough, row), F.when(F.col("rank") >= enough, at))
    other = F.min_by(row, F.struct((-F.col("rank")).alias("r"), "provider_ord", "cand_ord", "url"))
    out = rows.groupBy("doi").agg(good.alias("good"), other.alias("other"))
    return out.select("doi", F.coalesce("good", "other").alias("x"), F.col("good").isNotNull().alias("final")).select("doi", "x.provider", "x.url", "x.version", "x.rank", "final")


def failed_fetches(results: DataFrame) -> DataFrame:
    """(doi, failed_providers) of report rows that were neither fetched nor skipped; providers whose download failed."""
    bad = F.array_distinct(F.transform(F.filter("attempts", lambda a: F.coalesce(a.download_status, F.lit("ok")) != "ok"), lambda a: a.source))
    return results.where(~F.col("status").isin("fetched", "skipped")).select("doi", F.coalesce(bad, F.array().cast("array<string>")).alias("failed_providers"))


def fetch_summary(results: DataFrame) -> DataFrame:
    """(kind, name, n): counts by status, and successes by provider, largest first."""
    status = results.groupBy(F.lit("status").alias("kind"), F.col("status").alias("name")).agg(F.count("*").alias("n"))
    provider = results.where("status = 'fetched'").groupBy(F.lit("provider").alias("kind"), F.col("source").alias("name")).agg(F.count("*").alias("n"))
    return status.union(provider).orderBy("kind", F.desc("n"), "name")


def conversion_worklist(report: DataFrame, only: tuple[str, ...] = ("errors", "suspicious")) -> DataFrame:
    """(pdf, reason): failed conversions of a converter's report, errors before suspicious ones, each once."""
    parts = [report.select(F.explode(k).alias("x")).select("x.pdf", F.lit(k).alias("reason"), F.lit(i).alias("ord")) for i, k in enumerate(only)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("pdf").agg(F.min_by("reason", "ord").alias("reason")).orderBy("pdf")


def title_verified(similarity: Column, expected: Column, extracted: Column, least: float = 0.5) -> Column:
    """A download's title check: nothing to compare accepts."""
    return F.when(~X.truthy(expected) | ~X.truthy(extracted), F.lit(True)).otherwise(similarity >= least)


def pick_own_doi(candidates: DataFrame, metadata: DataFrame, titles: DataFrame, first: int = 6, least: float = 0.60) -> DataFrame:
    """(page_id, doi, score, confident) from candidates (page_id, ord, doi), metadata (doi, title) and document titles (page_id, title).

    Of the first candidates the one whose registered title is likest decides; below
    the limit the first candidate stands, without confidence.
    """
    from ..functions.python import title_similarity

    rows = candidates.where(F.col("ord") < first).join(metadata.select("doi", F.col("title").alias("registered")), "doi", "left").join(titles, "page_id", "left")
    score = F.coalesce(F.greatest(title_similarity(F.col("title"), F.col("registered")), X.title_overlap(F.col("title"), F.col("registered"))), F.lit(0.0))
    rows = rows.withColumn("score", score)
    best = F.max_by(F.struct("doi", "score"), F.struct("score", (-F.col("ord")).alias("o")))
    out = rows.groupBy("page_id").agg(best.alias("b"), F.min_by("doi", "ord").alias("first"))
    ok = F.col("b.score") >= least
    return out.select("page_id", F.when(ok, F.col("b.doi")).otherwise(F.col("first")).alias("doi"), "b.score", ok.alias("confident"))


def enrichment_summary(picked: DataFrame) -> DataFrame:
    """One row: documents, with a DOI, of high and of low confidence, without one; from (page_id, doi, confident)."""
    has, sure = F.col("doi").isNotNull(), F.coalesce("confident", F.lit(False))
    return picked.agg(F.count("*").alias("documents"), F.count_if(has).alias("with_doi"), F.count_if(has & sure).alias("high"), F.count_if(has & ~sure).alias("low"), F.count_if(~has).alias("without_doi"))


# Headings that are no titles, and what announces another work on a line.
PLAIN_HEADINGS = (
    "abstract", "introduction", "references", "bibliography", "glossary", "article info", "highlights", "keywords", "summary", "background", "methods", "method", "materials", "materials and methods", "results",
    "discussion", "conclusion", "conclusions", "acknowledgments", "acknowledgements", "corrections", "correction", "comment", "comments", "editorial", "erratum", "contents", "table of contents", "funding",
    "author contributions", "conflict of interest", "supplementary material", "figure", "table", "appendix", "notes", "part i", "part ii", "part iii", "subject category", "subject categories", "subject areas", "subject area",
    "author for correspondence", "cite this article", "research", "electronic supplementary material", "data accessibility", "competing interests", "authors' contributions", "interface", "the royal society",
    "review", "mini review", "original research", "open access", "graphical abstract",
)
OTHER_WORK = r"(?i)(refers?\s+to|comment(ary)?\s+on|in\s+response\s+to|reply\s+to|erratum|corrigendum|correction\s+to|retraction\s+of|this\s+article\s+is\s+a\s+commentary)"
TITLE_LETTERS, TITLE_WORDS = 15, 3
JUNK_TITLE = r"(?i)\.(docx|doc|pdf)$|^(untitled|microsoft|adobe|word)"
NO_TITLE_LINE = r"(?i)^(abstract|introduction|methods?|results?|discussion|background|keywords?|page \d+|doi|http|received|accepted|published|\d{4}\s*[—–,-])"


def document_title(body: Column, file_title: Column | None = None, stem: Column | None = None) -> Column:
    """The first heading that looks like a title; else the file's own title, if it is long enough and not the file's name."""
    heads = F.filter(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), lambda x: F.btrim(x).startswith("#"))
    bare = F.transform(heads, lambda x: F.rtrim(F.btrim(X.strip(F.ltrim(X.strip(x), F.lit("#"))), F.lit("*_")), F.lit(":.")))
    good = F.filter(bare, lambda h: ~F.lower(h).isin(*PLAIN_HEADINGS) & (F.length(h) >= TITLE_LETTERS) & (F.size(F.split(X.strip(h), r"\s+")) >= TITLE_WORDS))
    own = X.strip(F.coalesce(file_title, F.lit(""))) if file_title is not None else F.lit("")
    other = F.lower(own) != F.lower(stem) if stem is not None else F.lit(True)
    return F.coalesce(F.get(good, 0), F.when((F.length(own) >= TITLE_LETTERS) & other, own))


def own_doi_candidates(body: Column, page1: Column) -> Column:
    """Distinct lowered DOIs, the likeliest own one first: before the references, on the first page, anywhere; lines that announce another work are passed over."""

    def found(text: Column) -> Column:
        lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: ~x.rlike(OTHER_WORK))
        return F.flatten(F.transform(lines, X.extract_dois))

    return F.array_distinct(F.concat(found(X.body_before_references(body)), found(page1), found(body)))


def pdf_title(meta: Column, lines: Column) -> Column:
    """The metadata title unless it is junk, else the longest plausible of a first page's first 20 lines, the first of equals."""
    own = X.strip(F.coalesce(meta, F.lit("")))
    some = F.slice(F.filter(F.transform(F.slice(lines, 1, 40), X.strip), lambda x: x != ""), 1, 20)
    good = F.filter(some, lambda x: F.length(x).between(21, 249) & x.rlike("[A-Za-z]{4,}") & ~x.rlike(NO_TITLE_LINE))
    longest = F.aggregate(good, F.lit(""), lambda s, x: F.when(F.length(x) > F.length(s), x).otherwise(s))
    return F.when(F.length(own).between(16, 249) & ~own.rlike(JUNK_TITLE), own).otherwise(X.none_if_empty(longest))


def location_union(locations: DataFrame) -> DataFrame:
    """(doi, urls): distinct addresses of (doi, part, at, url), those of the first part first, blank ones dropped."""
    first = locations.where("trim(url) <> ''").groupBy("doi", F.btrim("url").alias("url")).agg(F.min(F.struct("part", "at")).alias("k"))
    return first.groupBy("doi").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "url"))), lambda x: x.url).alias("urls"))
