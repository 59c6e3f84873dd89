"""Analyses over sources: matrix, cohorts, metrics, effects, replication, regions, retrieval, routing, audits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python import match_offsets
from .names import find_keys, find_names, literal_names
from .overlap import overlap_pairs


#: Most raw patterns of a lexicon: each is tried on each text.
MOST_PATTERNS = 1000
#: A word's bound where only ASCII letters, digits and the underscore make words, whatever the Java version takes ``\\b`` for.
_ASCII_BOUND = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def lexicon_hits(texts: DataFrame, lexicon: DataFrame, column: str, ascii_words: bool = False) -> DataFrame:
    """The rows of ``texts`` with the ``key`` of each entry of ``lexicon(key, pattern)`` that ``column`` matches, letter case ignored; one row a key and pattern.

    Entries that are names between word bounds, however many, are looked up by one
    automaton. The others are patterns that someone wrote: they are tried on every
    text, and it is an error if there are more than ``MOST_PATTERNS``. ``ascii_words``
    takes word bounds as SQL engines with RE2 do, at which an accented letter is none.
    """
    split = lexicon.select(F.col("key").cast("string").alias("key"), "pattern", literal_names(F.col("pattern")).alias("names"))
    hits = find_names(texts, split.select("key", F.explode("names").alias("name")), column, ascii_words=ascii_words)
    raw = split.where("names is null and pattern is not null").select("key", "pattern")
    n = raw.limit(MOST_PATTERNS + 1).count()
    if n > MOST_PATTERNS:
        raise ValueError(f"a lexicon has at most {MOST_PATTERNS} patterns that are no names")
    if not n:
        return hits
    pattern = F.concat(F.lit("(?iU)"), "pattern")
    if ascii_words:
        pattern = F.concat(F.lit("(?iu)"), F.regexp_replace("pattern", r"(?<!\\)((?:\\\\)*)\\b", "$1" + _ASCII_BOUND))
    tried = texts.join(F.broadcast(raw), F.rlike(column, pattern))  # counted above
    return hits.union(tried.select(*texts.columns, "key"))


def lexicon_keys(texts: DataFrame, lexicon: DataFrame, column: str) -> DataFrame:
    """All rows of ``texts`` with the ``keys`` that ``lexicon_hits`` finds in each: no row is lost, repeated or shuffled."""
    split = lexicon.select(F.col("key").cast("string").alias("key"), "pattern", literal_names(F.col("pattern")).alias("names"))
    out = find_keys(texts, split.select("key", F.explode("names").alias("name")), column)
    raw = split.where("names is null and pattern is not null").select("key", "pattern").limit(MOST_PATTERNS + 1).collect()
    if len(raw) > MOST_PATTERNS:
        raise ValueError(f"a lexicon has at most {MOST_PATTERNS} patterns that are no names")
    tried = [F.when(F.rlike(column, F.lit(f"(?iU){r['pattern']}")), F.lit(r["key"])) for r in raw]
    return out.withColumn("keys", F.array_union("keys", F.array_compact(F.array(*tried)))) if tried else out


def matching(sources: DataFrame, domain: str | None = None, intervention: str | None = None, method: str | None = None) -> DataFrame:
    """Sources of a domain (case kept), an intervention family or entry, and a method (case ignored)."""
    out = sources
    if domain:
        out = out.where(F.array_contains("domain", domain))
    if intervention:
        low = intervention.lower()
        out = out.where(F.coalesce((F.lower("intervention_family") == low) | F.exists("interventions", lambda x: F.lower(x) == low), F.lit(False)))
    if method:
        out = out.where(F.exists("methods", lambda x: F.lower(x) == method.lower()))
    return out


def imaging_sources(sources: DataFrame) -> DataFrame:
    """Sources whose methods name diffusion imaging."""
    return sources.where(F.exists("methods", lambda m: F.upper(m).isin("DTI", "TRACTOGRAPHY", "DIFFUSION")))


def method_matrix(sources: DataFrame) -> DataFrame:
    """(slug, year, study_design, n, population, methods, interventions) by year; long fields are cut as in the table."""
    cut = lambda c, k: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, k), ", ")
    rows = sources.select("slug", "year", "study_design", "sample_size", F.substring("population", 1, 60).alias("population"), cut(F.col("methods"), 5).alias("methods"), cut(F.col("interventions"), 2).alias("interventions"))
    return rows.orderBy(F.coalesce("year", F.lit(9999)), "slug")


def pooled_samples(sources: DataFrame) -> DataFrame:
    """(family, studies, reported, pooled_n) of each family and, as null, of all."""
    n = X.as_int(F.col("sample_size"))
    family = F.coalesce(X.none_if_empty(F.col("intervention_family")), F.lit("none"))
    return sources.select(family.alias("family"), n.alias("n")).rollup("family").agg(F.count("*").alias("studies"), F.count("n").alias("reported"), F.sum("n").cast("long").alias("pooled_n"))


def descriptor_counts(sources: DataFrame, descriptors: DataFrame, text: str = "population") -> DataFrame:
    """(grp, label, n): sources whose text has a pattern of (grp, label, pattern)."""
    entries = descriptors.select(F.to_json(F.struct("grp", "label")).alias("key"), "grp", "label", "pattern")
    hit = lexicon_hits(sources.select("slug", F.col(text).alias("t")), entries, "t").select("slug", "key").distinct()
    return hit.join(entries.select("key", "grp", "label").distinct(), "key").groupBy("grp", "label").agg(F.count_distinct("slug").alias("n"))


def severity_extremes(sources: DataFrame, pattern: str, text: str = "population") -> DataFrame:
    """One row: the extremes of the lows and highs that a two-group pattern finds."""
    r = sources.select(X.severity_range(F.col(text), pattern).alias("r")).where("r is not null")
    return r.agg(F.min("r.low").alias("min_low"), F.max("r.low").alias("max_low"), F.min("r.high").alias("min_high"), F.max("r.high").alias("max_high"), F.count("*").alias("n"))


def cohort_report(sources: DataFrame, descriptors: DataFrame, text: str = "population", severity: str | None = None, intervention: str | None = None) -> DataFrame:
    """(section, item, value): sources and their pooled samples, how many name each descriptor (those that none names too), the range of severity, and samples by family.

    ``intervention`` keeps the sources of one family or entry, and leaves the families out.
    """
    kept = matching(sources, intervention=intervention)
    row = lambda df, section, item, value: df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("string").alias("value"))
    pooled = pooled_samples(kept)
    whole = pooled.where("family is null")
    named = descriptors.select("grp", "label").distinct().join(descriptor_counts(kept, descriptors, text), ["grp", "label"], "left")
    parts = [
        row(whole, "all", F.lit("sources"), F.col("studies")),
        row(whole, "all", F.lit("pooled"), F.col("pooled_n")),
        row(named, "descriptors", F.concat_ws("/", "grp", "label"), F.coalesce("n", F.lit(0))),
    ]
    if severity:
        s = severity_extremes(kept, severity, text)
        parts += [row(s, "severity", F.lit(name), F.concat_ws("-", F.col(a).cast("long"), F.col(b).cast("long"))) for name, a, b in (("lowest", "min_low", "min_high"), ("highest", "max_low", "max_high"))]
        parts.append(row(s, "severity", F.lit("reported"), F.col("n")))
    if not intervention:
        of = pooled.where("family is not null")
        parts.append(row(of, "families", F.col("family"), F.concat_ws(" sources, ", "studies", F.coalesce(F.col("pooled_n").cast("string"), F.lit("?")))))
    return functools.reduce(DataFrame.union, parts)


# values mined from text


def metric_pattern(metrics: dict[str, list[str]]) -> tuple[str, dict[str, str]]:
    """A pattern of (name, value, deviation) for metrics and their other names, and the metric of each lowered name."""
    import re

    names = {alias.lower(): metric for metric, aliases in metrics.items() for alias in (metric, *aliases)}
    flexible = sorted((r"\s+".join(map(re.escape, n.split())) for n in names), key=lambda x: (-len(x), x))
    return rf"\b({'|'.join(flexible)})\s*(?:\(?(?:value|=|:)?\)?\s*)?(\d+\.\d+)(?:\s*(?:[±+\-]|\+/-)\s*(\d+\.\d+))?", names


def metric_observations(sources: DataFrame, metrics: dict[str, list[str]], tracts: DataFrame, body: str = "body", window: int = 160) -> DataFrame:
    """(slug, pos, tract, metric, value, sd): values of metrics with the first tract of the lexicon (ord, label, pattern) within the window."""
    pattern, names = metric_pattern(metrics)
    found = sources.select("slug", F.col(body).alias("body"), F.explode(match_offsets(pattern, 3)(F.col(body))).alias("m"))
    low = F.btrim(F.lower(F.col("m.groups")[0]))
    metric = F.coalesce(*(F.when(low == k, F.lit(v)) for k, v in names.items()), F.upper(low))
    rows = found.select("slug", F.col("m.start").alias("pos"), metric.alias("metric"), F.col("m.groups")[1].cast("double").alias("value"), F.col("m.groups")[2].try_cast("double").alias("sd"), F.substring("body", F.greatest(F.col("m.start") - window, F.lit(0)) + 1, F.least(F.col("m.start"), F.lit(window)) + window).alias("near"))
    rows = rows.where("metric <> 'FA' or value between 0 and 1")
    # keys go with their row, so that text is searched once and nothing is shuffled
    entry = "struct<ord: int, label: string>"
    named = lexicon_keys(rows, tracts.where("ord is not null").select(F.to_json(F.struct(F.col("ord").cast("int").alias("ord"), "label")).alias("key"), "pattern"), "near")
    first = F.array_min(F.transform("keys", lambda k: F.from_json(k, entry)))
    return named.select("slug", "pos", first["label"].alias("tract"), "metric", "value", "sd")


def metric_summary(observations: DataFrame) -> DataFrame:
    """(tract, metric, n, low, high, mean)."""
    return observations.groupBy("tract", "metric").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def outcome_mentions(sources: DataFrame, outcome: str, pattern: str, body: str = "body", most: int = 400) -> DataFrame:
    """(slug, outcome, pos, sentence): the sentence around each match, between full stops or 200 letters on."""
    found = sources.select("slug", F.col(body).alias("b"), F.explode(match_offsets(pattern, 0)(F.col(body))).alias("m"))
    before = F.substring("b", F.lit(1), F.col("m.start"))
    start = F.length(before) - F.length(F.substring_index(before, ".", -1))
    rest = F.substring("b", F.col("m.end") + 1, F.length("b"))
    stop = F.instr(rest, ".")
    end = F.when(stop > 0, F.col("m.end") + stop - 1).otherwise(F.least(F.length("b"), F.col("m.end") + 200))
    sentence = F.btrim(F.substring("b", start + 1, end - start))
    return found.select("slug", F.lit(outcome).alias("outcome"), F.col("m.start").alias("pos"), F.when(F.length(sentence) > most, F.concat(F.substring(sentence, 1, most), F.lit("…"))).otherwise(sentence).alias("sentence"))


def effects(mentions: DataFrame) -> DataFrame:
    """Mentions with (delta, effect_size, p) where any is given."""
    return effect_values(mentions).where(SAYS_EFFECT)


#: Whether any value of ``effect_values`` is given.
SAYS_EFFECT = "delta is not null or effect_size is not null or p is not null"


def effect_values(mentions: DataFrame) -> DataFrame:
    """All mentions with (delta, effect_size, p), null where not given."""
    s = F.col("sentence")
    return mentions.withColumns({"delta": X.effect_delta(s), "effect_size": X.effect_size(s), "p": X.p_value(s)})


def effects_by_family(effect_rows: DataFrame, sources: DataFrame, shown: int = 10) -> DataFrame:
    """Effects by outcome and family, largest families first, at most ``shown`` of each (a report's limit)."""
    family = F.coalesce(X.none_if_empty(F.col("intervention_family")), F.lit("none"))
    rows = effect_rows.join(sources.select("slug", family.alias("family")), "slug")
    # a family is dealt to parts that are counted and cut by themselves; the first row of a part brings its count
    part = F.pmod(F.xxhash64("slug"), F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    deal = Window.partitionBy("outcome", "family", "part")
    rows = rows.withColumn("part", part).withColumns({"n": F.count("*").over(deal), "r": F.row_number().over(deal.orderBy("slug", "pos"))}).where(F.col("r") <= shown).drop("part")
    own = Window.partitionBy("outcome", "family")
    rows = rows.withColumns({"n": F.sum(F.when(F.col("r") == 1, F.col("n"))).over(own), "r": F.row_number().over(own.orderBy("slug", "pos"))})
    return rows.where(F.col("r") <= shown).orderBy("outcome", F.desc("n"), "family", "r")


# replication


def replication_chains(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((original, replications), (slug, missing_doi)): declared replications of known originals, and those of unknown ones."""
    from .citations import doi_owner

    said = sources.select("slug", F.lower(F.btrim("replication_of")).alias("doi")).where("doi <> ''")
    joined = said.join(doi_owner(sources).withColumnRenamed("slug", "original"), "doi", "left")
    chains = joined.where("original is not null").groupBy("original").agg(F.sort_array(F.collect_list("slug")).alias("replications"))
    return chains, joined.where("original is null").select("slug", F.col("doi").alias("missing_doi"))


def replication_candidates(sources: DataFrame, least: float = 0.4, top: int | None = 30, parity: bool = False) -> DataFrame:
    """(a, b, family, design, overlap): pairs of a family and design with alike populations that don't declare each other.

    The ``top`` best in order, or all of them in no order. ``parity`` also takes two empty identifiers as a declaration.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("population", F.lit(""))), F.lit(r"(?U)\w{4,}"), F.lit(0)))
    blank = lambda c: F.coalesce(F.lower(F.btrim(c)), F.lit(""))
    rows = sources.where(X.truthy(F.col("intervention_family")) & X.truthy(F.col("study_design"))).select("slug", F.col("intervention_family").alias("family"), F.col("study_design").alias("design"), words.alias("w"), blank("doi").alias("doi"), blank("replication_of").alias("of"))
    # what the declarations are about goes with the id
    rows = rows.select("family", "design", "w", F.struct("slug", "doi", "of").alias("id"))
    groups = ["family", "design"]
    said = lambda c: F.lit(True) if parity else c != ""
    first = None
    if top:
        # an id leaves out at most so many others, so pairs with later ids of a class come after ``top`` better ones
        count = lambda c: rows.where(said(F.col(f"id.{c}"))).groupBy(*groups, F.col(f"id.{c}").alias("k")).agg(F.count("*").alias(f"n_{c}"))
        out = lambda c: F.coalesce(F.max(f"n_{c}"), F.lit(0))
        first = top + 1 + sum(count("doi").join(count("of"), [*groups, "k"]).agg(out("doi"), out("of")).first())
    pairs = overlap_pairs(rows, groups, "id", "w", least, first)
    same = lambda p, q: (p == q) & said(p)
    pairs = pairs.where(~same(F.col("a.of"), F.col("b.doi")) & ~same(F.col("b.of"), F.col("a.doi")))
    pairs = pairs.select("a.slug", F.col("b.slug").alias("b"), "family", "design", "overlap").withColumnRenamed("slug", "a")
    return pairs.orderBy(F.desc("overlap"), "family", "a", "b").limit(top) if top else pairs


def single_study_concepts(concepts: DataFrame, sources: DataFrame, header: str = "Empirical Evidence") -> DataFrame:
    """(concept, source): concepts whose evidence section names exactly one source."""
    named = concepts.select(F.col("slug").alias("concept"), F.explode(F.array_distinct(X.strict_links(F.coalesce(X.section(F.col("body"), header), F.lit(""))))).alias("source"))
    return named.join(sources.select(F.col("slug").alias("source")), "source", "left_semi").groupBy("concept").agg(F.count("*").alias("n"), F.min("source").alias("source")).where("n = 1").select("concept", "source")


def replication_report(sources: DataFrame, concepts: DataFrame, least: float = 0.4, top: int | None = 30) -> DataFrame:
    """(section, a, b, detail): declared replications, those of unknown originals, concepts that rest on one study, and pairs that may replicate each other (a report's ``top``)."""
    chains, unknown = replication_chains(sources)
    row = lambda df, section, a, b, detail: df.select(F.lit(section).alias("section"), F.col(a).alias("a"), F.col(b).alias("b"), detail.cast("string").alias("detail"))
    parts = [
        row(chains.select("original", F.explode("replications").alias("slug")), "replicated", "original", "slug", F.lit("")),
        row(unknown, "unknown original", "slug", "missing_doi", F.lit("")),
        row(single_study_concepts(concepts, sources), "single study", "concept", "source", F.lit("")),
        row(replication_candidates(sources, least, top), "candidate", "a", "b", F.concat_ws(" ", "family", F.round("overlap", 2))),
    ]
    return functools.reduce(DataFrame.union, parts)


# regions


def region_snippets(sentences: DataFrame, regions: DataFrame, cap: int = 3, ascii_words: bool = False) -> DataFrame:
    """(key, label, page_id, pos, sentence): sentences that name a region of the lexicon (key, label, pattern), the first ``cap`` of a page (a report's limit)."""
    hit = lexicon_hits(sentences.select("page_id", "pos", "sentence"), regions, "sentence", ascii_words).dropDuplicates(["key", "page_id", "pos"])
    hit = hit.join(regions.select("key", "label").distinct(), "key")
    rank = F.row_number().over(Window.partitionBy("key", "page_id").orderBy("pos"))
    return hit.withColumn("r", rank).where(F.col("r") <= cap).select("key", "label", "page_id", "pos", "sentence")


def region_index(snippets: DataFrame, top: int = 5) -> DataFrame:
    """(key, label, n_sources, top_sources): by most snippets."""
    per = snippets.groupBy("key", "label", "page_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "page_id"))
    rows = per.withColumn("r", rank)
    best = F.sort_array(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "page_id"))))
    return rows.groupBy("key", "label").agg(F.count("*").alias("n_sources"), F.transform(best, lambda x: x.page_id).alias("top_sources"))


def region_view(sentences: DataFrame, regions: DataFrame, key: str, cap: int = 3, ascii_words: bool = False) -> DataFrame:
    """(page_id, pos, sentence): the pages of one region with their first ``cap`` sentences (a report's limit)."""
    return region_snippets(sentences, regions.where(F.col("key") == key), cap, ascii_words).select("page_id", "pos", "sentence").orderBy("page_id", "pos")


# retrieval


def retrieve(index: DataFrame, pages: DataFrame, edges: DataFrame, question: str, k: int = 15) -> DataFrame:
    """(ord, path): the overview, index pages whose title bears on the question, then their neighbours; the first ``k``."""
    hits = index.where(X.index_match(F.col("title"), question)).select(F.col("href").alias("path"), "ord").join(pages.select("path"), "path", "left_semi").groupBy("path").agg(F.min("ord").alias("ord"))
    ids = hits.select(X.page_id(F.col("path")).alias("id"))
    from .graph import neighbourhood

    near = neighbourhood(edges, ids, 0.7).join(ids, "id", "left_anti").select(F.concat("id", F.lit(".md")).alias("path")).join(pages.select("path"), "path", "left_semi")
    front = pages.where("path = 'overview.md'").select("path").join(hits, "path", "left_anti")
    rows = front.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), "path").union(hits.select(F.lit(1), F.col("ord").cast("long"), "path")).union(near.select(F.lit(2), F.lit(0).cast("long"), "path"))
    best = rows.orderBy("part", "at", "path").limit(k)
    return best.select((F.row_number().over(Window.orderBy("part", "at", "path")) - 1).alias("ord"), "path")  # at most k rows


def entity_contexts(pages: DataFrame, names: DataFrame, cap: int = 15) -> DataFrame:
    """(name, page_id, ord): pages, neither entities nor concepts, whose text has a missing entity's name; the first ``cap`` (a report's limit)."""
    texts = pages.where(~F.col("kind").isin("entities", "concepts")).select("page_id", F.lower("content").alias("text"))
    rows = find_names(texts, names.select(F.col("name").alias("key"), F.lower("name").alias("name")), "text", whole_words=False, fold=False)
    rows = rows.select(F.col("key").alias("name"), "page_id")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("page_id"))
    return rows.select("name", "page_id", rank.alias("ord")).where(F.col("ord") <= cap)


# audits


def raw_audit(sources: DataFrame, raw: DataFrame) -> DataFrame:
    """(slug, status, raw_path): ok, rename, missing or ambiguous, from sources (slug, source_file) and raw files (path, stem_slug)."""
    exact = sources.join(raw.select(F.col("path").alias("source_file"), F.col("stem_slug").alias("pointed")), "source_file", "left")
    stems = raw.groupBy(F.col("stem_slug").alias("slug")).agg(F.count_distinct("path").alias("n"), F.min("path").alias("candidate"))
    rows = exact.join(stems, "slug", "left")
    one = F.col("n") == 1
    status = F.when(F.col("pointed").isNotNull(), F.when(F.col("pointed") == F.col("slug"), "ok").otherwise("rename")).when(one, F.when(F.col("candidate") == F.col("source_file"), "ok").otherwise("rename")).when(F.col("n") > 1, "ambiguous").otherwise("missing")
    path = F.when(F.col("pointed").isNotNull(), F.col("source_file")).when(one, F.col("candidate"))
    return rows.select("slug", status.alias("status"), path.alias("raw_path"))


def orphan_raws(raw: DataFrame, audit: DataFrame, sources: DataFrame) -> DataFrame:
    """Raw files that no source points at, matches or is named like."""
    used = audit.where("raw_path is not null").select(F.col("raw_path").alias("path"))
    pointed = sources.where("source_file <> ''").select(F.col("source_file").alias("path"))
    return raw.join(used, "path", "left_anti").join(pointed, "path", "left_anti").join(sources.select(F.col("slug").alias("stem_slug")), "stem_slug", "left_anti").select("path")


def audit_summary(audit: DataFrame) -> DataFrame:
    """(status, n, exit_code): the exit code counts unresolved rows, 99 at most."""
    all_ = Window.partitionBy()
    rows = audit.groupBy("status").agg(F.count("*").alias("n"))
    bad = F.sum(F.when(F.col("status").isin("missing", "ambiguous"), F.col("n")).otherwise(0)).over(all_)  # four rows at most
    return rows.withColumn("exit_code", F.least(bad, F.lit(99)).cast("int"))


def page_trail(blame: DataFrame, log: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(commit, first_line, lines, author, day, summary, ingest): lines by commit in order of appearance, with that day's first ingest."""
    rows = blame
    if first is not None:
        rows = rows.where(F.col("line_num").between(first, last))
    by = rows.groupBy("commit").agg(F.min("line_num").alias("first_line"), F.count("*").alias("lines"), F.first("author").alias("author"), F.first("timestamp").alias("ts"), F.first("summary").alias("summary"))
    by = by.withColumn("day", F.to_date(F.timestamp_seconds("ts")))
    ingests = log.where("op = 'ingest'").groupBy(F.col("entry_date").alias("day")).agg(F.min_by("title", "ord").alias("ingest"))
    return by.join(ingests, "day", "left").select("commit", "first_line", "lines", "author", "day", "summary", "ingest").orderBy("first_line")


def section_lines(pages: DataFrame, section: str) -> DataFrame:
    """(page_id, first, last): the lines of a page's ``## section``, for ``page_trail``; pages without it have no row.

    It goes on to the line of the next heading of that level, less the blank lines
    behind its own heading, or to the page's end.
    """
    quoted = "".join(f"\\{c}" if c in r"\^$.|?*+()[]{}-/" else c for c in section)
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n")
    at = F.transform(lines, lambda x, i: F.when(x.rlike(rf"^##\s+{quoted}\s*$"), i + 1))
    rows = pages.select("page_id", lines.alias("lines"), F.array_min(at).alias("first")).where("first is not null")
    later = F.transform("lines", lambda x, i: F.when((i + 1 > F.col("first")) & x.rlike(r"^##(\s|$)"), i + 1))
    said = F.transform("lines", lambda x, i: F.when((i + 1 > F.col("first")) & (F.btrim(x) != ""), i + 1))
    following, text = F.array_min(later), F.coalesce(F.array_min(said), F.size("lines") + 1)
    last = F.when(following.isNotNull(), following - (text - F.col("first") - 1)).otherwise(F.size("lines"))
    return rows.select("page_id", "first", last.alias("last"))


def dash_report(files: DataFrame) -> DataFrame:
    """One row: files with dashes, and dashes in all."""
    c = X.dash_counts(F.col("content"))
    n = c.em + F.when(F.col("path").endswith(".md"), c.en).otherwise(0)
    return files.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("files_hit"), F.sum("n").cast("long").alias("total"))


# routing

# Folders by intervention family, review design and imaging method.
FAMILY_FOLDER = {"bci": "bci", "tms": "tms", "tdcs": "tdcs", "mirror": "mirror-therapy", "robot": "robot-therapy", "mental-practice": "mental-practice", "physio": "physio", "combined": "general"}
REVIEW_FOLDER = {"systematic-review": "systematic", "meta-analysis": "systematic", "scoping-review": "scoping", "narrative-review": "narrative"}
IMAGING_FOLDER = {"DTI": "dti", "Tractography": "dti", "fMRI": "fmri", "MRI": "fmri", "EEG": "eeg", "MEG": "meg", "PET": "pet"}
FLAT_DESIGNS = {"systematic-review": "reviews/systematic", "meta-analysis": "reviews/systematic", "scoping-review": "reviews/scoping", "narrative-review": "reviews/narrative", "theoretical": "theory", "methodological": "methodology"}
FLAT_FAMILIES = {"bci": "bci", "mi-bci": "bci", "tms": "tms", "rtms": "tms", "itbs": "tms", "ctbs": "tms", "tbs": "tms", "nibs": "tms", "fes": "fes", "nmes": "fes", "mental-practice": "mental-practice", "mental practice": "mental-practice", "physio": "physio", "rehabilitation": "physio", "tdcs": "tdcs", "mirror-therapy": "physio", "robot-therapy": "physio", "combined": "bci", "neurofeedback": "bci"}


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in table.items()))


def route(sources: DataFrame, promote: bool = False, threshold: int = 3, parity: bool = False, existing: tuple[str, ...] = ()) -> DataFrame:
    """(slug, folder, tier2, target): the folder of each source, first rule first.

    A subfolder of an intervention needs ``promote`` and ``threshold`` sources, or
    to be in ``existing``; with ``parity`` that holds for every subfolder.
    """
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), X.normalized)
    design, family, sub = (X.normalized(F.col(c)) for c in ("study_design", "intervention_family", "intervention_subfamily"))
    modality = F.get(F.array_compact(F.transform(F.coalesce("methods", F.array().cast("array<string>")), lambda m: _lookup(m, IMAGING_FOLDER))), 0)
    place = lambda folder, tier2, kind: F.struct(folder.alias("folder"), tier2.alias("tier2"), F.lit(kind).alias("kind"))
    none = F.lit(None).cast("string")
    rule = (
        F.when(F.array_contains(tags, "thesis"), place(F.lit("theses"), F.col("slug"), "fixed"))
        .when(F.array_contains(tags, "thesis-chapter"), place(F.lit("theses"), F.coalesce(X.none_if_empty(F.col("parent_thesis")), F.lit("unknown-thesis")), "fixed"))
        .when(_lookup(design, REVIEW_FOLDER).isNotNull(), place(F.lit("articles/reviews"), _lookup(design, REVIEW_FOLDER), "fixed"))
        .when(design == "theoretical", place(F.lit("articles/theory"), none, "fixed"))
        .when(design == "methodological", place(F.lit("articles/methodology"), none, "fixed"))
        .when((family != "") & (family != "none"), place(F.concat(F.lit("articles/"), F.coalesce(_lookup(family, FAMILY_FOLDER), family)), F.when(sub != "", sub), "family"))
        .when(modality.isNotNull(), place(F.lit("articles/imaging"), modality, "fixed"))
        .otherwise(place(F.lit("articles/general"), none, "fixed"))
    )
    rows = sources.select("slug", rule.alias("r")).select("slug", "r.folder", "r.tier2", "r.kind")
    size = F.count("*").over(Window.partitionBy("folder", "tier2"))
    there = F.concat_ws("/", "folder", "tier2").isin(*existing) if existing else F.lit(False)
    enough = (size >= threshold) if promote else there
    stays = F.col("tier2").isNull() | enough | ((F.col("kind") == "fixed") if not parity else F.lit(False))
    rows = rows.withColumn("tier2", F.when(stays, F.col("tier2")))
    return rows.select("slug", "folder", "tier2", F.concat(F.concat_ws("/", "folder", "tier2"), F.lit("/"), "slug", F.lit(".md")).alias("target"))


def route_flat(sources: DataFrame, imagery: str, imaging: str, modality: Column | None = None) -> DataFrame:
    """(slug, folder): the older router; theses have none, design goes before family, then hints in slugs by the given patterns."""
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    design = F.replace(F.lower(F.coalesce("study_design", F.lit(""))), F.lit("_"), F.lit("-"))
    family = F.btrim(F.lower(F.coalesce("intervention_family", F.lit(""))))
    folder = (
        F.when(F.arrays_overlap(tags, F.array(F.lit("thesis"), F.lit("thesis-chapter"))), F.lit(None).cast("string"))
        .when(_lookup(design, FLAT_DESIGNS).isNotNull(), _lookup(design, FLAT_DESIGNS))
        .when((family != "") & (family != "none"), F.coalesce(_lookup(family, FLAT_FAMILIES), family))
        .when(F.col("slug").rlike(imagery), "imagery")
        .when(F.col("slug").rlike(imaging), modality if modality is not None else F.lit("imaging"))
        .when(F.arrays_overlap(tags, F.array(F.lit("physio"), F.lit("rehabilitation"))), "physio")
        .otherwise("general")
    )
    return sources.select("slug", folder.alias("folder"))
