"""Row-generating operators: links, citations, sentences, reference entries, chapters, log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .overlap import class_blocks, expand_pairs


def link_occurrences(pages: DataFrame, body: str = "content", grammar: str = "loose") -> DataFrame:
    """(page_id, pos, target): every wikilink in order, repeats kept; strict grammar takes plain slugs only."""
    found = X.loose_links(F.col(body)) if grammar == "loose" else X.strict_links(F.col(body))
    return pages.select("page_id", F.posexplode(found).alias("pos", "target"))


def cite_rows(sources: DataFrame) -> DataFrame:
    """(slug, ord, doi) of every ``cites`` entry, trimmed and lowered, repeats kept."""
    return sources.select("slug", F.posexplode("cites").alias("ord", "raw")).select("slug", "ord", F.lower(F.btrim("raw")).alias("doi"))


def sentences(pages: DataFrame, body: str = "body", least: int = 20, most: int = 280) -> DataFrame:
    """(page_id, pos, sentence): sentences end at . ! or ? before white space; short ones are passed over, long ones cut."""
    split = pages.select("page_id", F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), r"(?<=[.!?])\s+")).alias("pos", "s"))
    return split.select("page_id", "pos", F.btrim("s").alias("s")).where(F.length("s") >= least).select("page_id", "pos", F.substring("s", 1, most).alias("sentence"))


def reference_entries(block: Column, least: int = 30) -> Column:
    """Entries of a references block: by numbered markers, else by blank lines, else the block as one; short ones dropped."""
    lines = F.split(block, "\n")
    numbered = F.exists(lines, lambda x: x.rlike(X.ENTRY_START))
    # a mark before each numbered line that follows other text makes the entries separable
    kept = F.filter(F.transform(lines, lambda x: F.struct(F.btrim(x).alias("t"), x.rlike(X.ENTRY_START).alias("m"))), lambda x: x.t != "")
    joined = F.array_join(F.transform(kept, lambda x: F.concat(F.when(x.m, F.lit("\x1e")).otherwise(F.lit(" ")), x.t)), "")
    by_marker = F.split(F.regexp_replace(joined, "^[\x1e ]", ""), "\x1e")
    squeeze = lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))
    chunks = F.filter(F.split(block, r"\n\s*\n"), lambda x: F.length(F.btrim(x)) >= least)
    blank = F.when(F.size(chunks) <= 1, F.array(squeeze(block))).otherwise(F.transform(chunks, squeeze))
    out = F.when(numbered, F.transform(by_marker, lambda x: F.btrim(x))).otherwise(blank)
    return F.filter(out, lambda e: F.length(e) >= least)


def resolve_references(entries: DataFrame, own: str = "own_doi", valid: DataFrame | None = None, hits: DataFrame | None = None, cut: int = 200) -> DataFrame:
    """(slug, cites, cites_curated, cites_unresolved) from (slug, own_doi, entries array<string>).

    In order, each entry takes its first DOI that is not yet taken (the document's
    own counts as taken). ``valid(doi, valid)`` is a snapshot: a DOI it marks false
    is passed over, an absent one counts as valid. Entries that take none may be
    answered by ``hits(query_hash, rank, score, overlap, doi)``; such answers are
    ``cites_curated``, and stand behind the others in ``cites``.
    """
    rows = entries.select("slug", F.lower(F.coalesce(F.btrim(F.col(own)), F.lit(""))).alias("own"), F.transform("entries", lambda e: F.struct(e.alias("entry"), X.extract_dois(e).alias("dois"))).alias("entries"))
    if valid is not None:
        bad = rows.select("slug", F.explode("entries").alias("e")).select("slug", F.explode("e.dois").alias("doi")).join(valid.where("not valid").select(F.lower("doi").alias("doi")), "doi").groupBy("slug").agg(F.collect_set("doi").alias("bad"))
        rows = rows.join(bad, "slug", "left")
    else:
        rows = rows.withColumn("bad", F.lit(None).cast("array<string>"))
    if hits is not None:
        best = hits.where("score >= 50 and overlap >= 0.5").groupBy("query_hash").agg(F.min_by(F.lower("doi"), "rank").alias("found"))
        asked = rows.select("slug", F.posexplode("entries").alias("pos", "e")).withColumn("query_hash", X.query_hash(F.col("e.entry"))).join(best, "query_hash")
        answers = asked.groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), "found"))).alias("answers"))
        rows = rows.join(answers, "slug", "left")
    else:
        rows = rows.withColumn("answers", F.lit(None).cast("map<int,string>"))
    bad = F.coalesce("bad", F.array().cast("array<string>"))
    start = F.struct(F.array("own").alias("seen"), *(F.array().cast("array<string>").alias(c) for c in ("cites", "curated", "open")), F.lit(0).alias("i"))

    def step(s: Column, e: Column) -> Column:
        fresh = F.filter(e.dois, lambda d: ~F.array_contains(s.seen, d) & ~F.array_contains(bad, d))
        answer = F.col("answers")[s.i]
        return X.let(F.get(fresh, 0), lambda own: X.let(F.when(own.isNull() & ~F.array_contains(s.seen, answer), answer), lambda found: taken(s, e, own, found)))

    def taken(s: Column, e: Column, own_pick: Column, found: Column) -> Column:
        pick = F.coalesce(own_pick, found)
        grown = lambda to, x: F.when(x.isNotNull(), F.array_append(to, x)).otherwise(to)
        return F.struct(
            grown(s.seen, pick).alias("seen"),
            grown(s.cites, own_pick).alias("cites"),
            grown(s.curated, found).alias("curated"),
            F.when(pick.isNull(), F.array_append(s.open, F.substring(e.entry, 1, cut))).otherwise(s.open).alias("open"),
            (s.i + 1).alias("i"),
        )

    out = rows.withColumn("r", F.aggregate("entries", start, step))
    return out.select("slug", F.concat("r.cites", "r.curated").alias("cites"), F.col("r.curated").alias("cites_curated"), F.col("r.open").alias("cites_unresolved"))


def log_rows(logs: DataFrame, body: str = "content") -> DataFrame:
    """(page_id, ord, entry_date, op, title) of every ``## [date] op | title`` header."""
    found = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(X.LOG_HEADER), F.lit(0))
    rows = logs.select("page_id", F.posexplode(found).alias("ord", "h"))
    part = lambda k: F.btrim(F.regexp_extract("h", X.LOG_HEADER, k))
    return rows.select("page_id", "ord", part(1).try_cast("date").alias("entry_date"), part(2).alias("op"), part(3).alias("title"))


def index_links(index: DataFrame, body: str = "content") -> DataFrame:
    """(title, href): distinct links to Markdown files."""
    pattern = r"\[([^\]]+)\]\(([^)]+\.md)\)"
    found = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(pattern), F.lit(0))
    return index.select(F.explode(found).alias("m")).select(F.regexp_extract("m", pattern, 1).alias("title"), F.regexp_extract("m", pattern, 2).alias("href")).distinct()


def doi_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(doi, pos): trimmed and lowered entries in order of first appearance, comments and blanks dropped."""
    rows = lines.select(F.monotonically_increasing_id().alias("pos"), F.lower(F.btrim(F.col(column))).alias("doi")).where("doi <> '' and not startswith(doi, '#')")
    return rows.groupBy("doi").agg(F.min("pos").alias("pos")).orderBy("pos", "doi")


def pairs_within(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, a, b) for each pair of a key's rows with a before b: blocks of rows meet, so a large key is dealt to many tasks."""
    blocks = class_blocks(rows, [key], order)
    side = lambda s: blocks.select(key, F.col("blk").alias(f"blk_{s}"), F.col("ids").alias(f"ids_{s}"))
    return expand_pairs(side("a").join(side("b"), key), True)


# chapters

ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}
_DASHES = "[\\s.:—–-]*"
# Heading patterns and the names of chapters without a number.
CHAPTER_PATTERNS = (
    rf"(?i)^#\s+(?:chapter|chapitre)\s+(\d{{1,2}})\b{_DASHES}(.*?)\s*$",
    r"^#\s+(\d{1,2})\s*[.)\-:]\s+(.+?)\s*$",
    rf"(?iu)^#\s+(?:etude|étude|study|partie|part|axe)\s+(\d{{1,2}})\b{_DASHES}(.*?)\s*$",
    rf"(?iu)^#\s+(?:etude|étude|study|partie|part|axe)\s+(I{{1,3}}|IV|V|VI{{0,3}}|IX|X)\b{_DASHES}(.*?)\s*$",
    r"^#\s+(I{1,3}|IV|V|VI{0,3}|IX|X)\s*[.)\-:]\s+(.+?)\s*$",
)
NAMED_CHAPTERS = (
    "general introduction", "literature review", "background", "theoretical framework", "general methods", "general discussion", "general conclusion", "references", "bibliography", "appendix", "appendices", "perspectives",
    "introduction generale", "introduction générale", "cadre theorique", "cadre théorique", "contribution experimentale", "contribution expérimentale", "discussion generale", "discussion générale", "conclusion generale", "conclusion générale",
    "conclusion et perspectives", "problematique generale", "problématique générale", "remerciements", "resume", "résumé", "abstract", "sommaire", "annexes", "annexe", "references bibliographiques", "références bibliographiques",
)


def chapter_heading(line: Column) -> Column:
    """(number, title) of a chapter heading, null for other lines; named chapters have no number."""
    romans = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))

    def of(clean: Column) -> Column:
        def numbered(p: str) -> Column:
            whole = lambda g: F.coalesce(g.try_cast("int"), F.try_element_at(romans, F.upper(g)))
            title = F.rtrim(F.btrim(F.regexp_extract(clean, p, 2)), F.lit(".:"))
            number = X.let(F.regexp_extract(clean, p, 1), lambda g: F.when(g != "", whole(g)))
            return X.let(number, lambda n: F.when(n.isNotNull(), F.struct(n.alias("number"), title.alias("title"))))

        def named(body: Column) -> Column:
            known = F.lit(False)
            for n in NAMED_CHAPTERS:
                known = known | (body == n) | body.startswith(n + " ")
            return F.when(known, F.struct(F.lit(None).cast("int").alias("number"), body.alias("title")))

        body = F.rtrim(F.lower(F.btrim(F.substring(clean, F.lit(3), F.length(clean)))), F.lit(":."))
        return F.coalesce(*(numbered(p) for p in CHAPTER_PATTERNS), X.let(body, named))

    clean = X.strip(F.regexp_replace(F.regexp_replace(X.strip(line), r"(?i)<span[^>]*>|</span>", ""), r"\*+", ""))
    return F.when(line.rlike(r"\A\s*# \s*\S"), X.let(clean, of))


def chapters(docs: DataFrame, body: str = "body", least: int = 1500) -> DataFrame:
    """(page_id, ord, number, title, text): a thesis cut at its chapter headings; short parts and the preamble are dropped.

    A heading without number takes the next after the highest so far, a fold over
    the document's lines, so each document is handled within its row.
    """
    lines = F.split(F.coalesce(F.col(body), F.lit("")), r"(?<=\n)")
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"), chapter_heading(x).alias("h"))), lambda x: x.h.isNotNull())
    # the fold goes over headings alone, and each chapter is one slice of the lines
    start = F.struct(F.array().cast("array<struct<at: int, number: int, title: string>>").alias("done"), F.lit(0).alias("top"))

    def step(s: Column, x: Column) -> Column:
        number = F.coalesce(x.h.number, s.top + 1)
        title = F.coalesce(X.none_if_empty(x.h.title), X.strip(F.ltrim(F.regexp_replace(x.line, r"\*+", ""), F.lit("# "))))
        return F.struct(F.array_append(s.done, F.struct(x.at.alias("at"), number.alias("number"), title.alias("title"))).alias("done"), F.greatest(s.top, number).alias("top"))

    found = docs.select("page_id", lines.alias("lines"), F.aggregate(heads, start, step, lambda s: s.done).alias("c"))
    rows = found.select("page_id", "lines", F.expr("transform(c, (x, i) -> struct(x.at, x.number, x.title, coalesce(get(c, i + 1).at, size(lines)) as stop))").alias("c"))
    text = lambda x: F.array_join(F.slice(F.col("lines"), x.at + 1, x.stop - x.at), "")
    whole = F.transform("c", lambda x: F.struct(x.number.alias("number"), x.title.alias("title"), text(x).alias("text")))
    return rows.select("page_id", F.posexplode(whole).alias("ord", "c")).select("page_id", "ord", "c.*").where(F.length("text") >= least)


# figures

# Image references, caption starts and lines that may stand between panels.
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
CAPTION = r"(?i)^\s*\**\s*(?:Fig(?:ure)?s?\.?)\s*(\d+)\s*([A-Za-z])?\b[.:–-]?\s*(.*)"
NOISE = r"^\s*($|\d{1,4}\s*$|\(?[A-Za-z][.)]?\s*$|.{0,80}\b(19|20)\d{2}\b.{0,40}\d{2,4}[-–]\d{2,4}\s*$)"


def figure_captions(docs: DataFrame, body: str = "body", reach: int = 29) -> DataFrame:
    """(page_id, image_id, fig, panel, part, caption) of images whose run has a caption below.

    A run of image lines, noise lines between passed over, shares the first caption
    within ``reach`` lines below its last image that comes before the next image.
    """
    lines = docs.select("page_id", F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\n")).alias("i", "line"))
    by_page = Window.partitionBy("page_id").orderBy("i")
    lines = lines.withColumns({"image": X.first_group(F.col("line"), IMAGE), "noise": F.col("line").rlike(NOISE), "cap": F.when(F.col("line").rlike(CAPTION) & (F.length(F.btrim("line")) > 15), F.col("line"))})
    lines = lines.withColumn("breaks", F.sum(F.when(F.col("image").isNull() & ~F.col("noise"), 1).otherwise(0)).over(by_page))
    images = lines.where("image is not null")
    run = Window.partitionBy("page_id", "breaks")
    images = images.withColumns({"last": F.max("i").over(run), "n": F.count("*").over(run), "k": F.row_number().over(run.orderBy("i"))})
    spots = lines.where("cap is not null or image is not null").select(F.col("page_id").alias("p"), F.col("i").alias("at"), F.col("cap").alias("text"), F.col("image").isNotNull().alias("is_image"))
    runs = images.select("page_id", "breaks", "last").distinct()
    below = runs.join(spots, (F.col("p") == F.col("page_id")) & (F.col("at") > F.col("last")) & (F.col("at") <= F.col("last") + reach))
    first = below.groupBy("page_id", "breaks").agg(F.min_by(F.struct("text", "is_image"), "at").alias("f")).where("not f.is_image").select("page_id", "breaks", F.col("f.text").alias("text"))
    out = images.join(first, ["page_id", "breaks"])
    name = F.element_at(F.split("image", "/"), -1)
    part = F.when(F.col("n") > 1, F.concat(F.lit("p"), F.col("k").cast("string"))).otherwise("")
    caption = F.substring(F.btrim(F.regexp_replace(F.regexp_extract("text", CAPTION, 3), r"\s+", " ")), 1, 600)
    return out.select("page_id", name.alias("image_id"), F.regexp_extract("text", CAPTION, 1).alias("fig"), F.lower(F.regexp_extract("text", CAPTION, 2)).alias("panel"), part.alias("part"), caption.alias("caption"))


def figure_bank(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Figure records of (page_id, image_id, file, bytes): label, title slug, caption, and whether the image is page furniture."""
    from ..functions.python import figure_slug

    rows = images.join(captions, ["page_id", "image_id"], "left")
    page, size = Window.partitionBy("page_id"), Window.partitionBy("page_id", "bytes")
    rows = rows.withColumns({"all": F.count("*").over(page), "with_caption": F.count("caption").over(page), "same": F.count("*").over(size)})
    label = F.when(F.col("fig").isNotNull(), F.concat(F.lit("fig-"), "fig", "panel", F.when(F.col("part") != "", F.concat(F.lit("-"), "part")).otherwise(""))).otherwise("unlabelled")
    noise = F.col("caption").isNull() & (((F.col("all") >= 60) & (F.col("with_caption") < F.col("all") * 0.2)) | (F.col("same") >= 3))
    slug = F.concat("page_id", F.lit("--"), "label", F.when(F.col("caption").isNotNull(), F.concat(F.lit("--"), figure_slug(F.col("caption")))).otherwise(""))
    rows = rows.withColumn("label", label)
    return rows.select(F.col("page_id").alias("source"), "file", "image_id", F.col("label").alias("figure"), slug.alias("title_slug"), F.coalesce("caption", F.lit("")).alias("caption"), "bytes", noise.alias("noise"))
