"""Column functions that Spark evaluates itself; ``python.py`` has those that need Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
PAGE_REF = r"\(p\.\s*([0-9?]+)\)"
STRICT_LINK = r"\[\[([A-Za-z0-9\-_/.]+)\]\]"
LOOSE_LINK = r"\[\[([^\]]+)\]\]"
LOG_HEADER = r"(?md)^## \[(\d{4}-\d{2}-\d{2})\] ([^|\n]+?) \| ([^\n]+)$"
REFERENCE_HEADERS = ("references", "bibliography", "cited works", "works cited", "literature cited", "réferences", "références")
ENTRY_START = r"^\s*(?:\[\d+\]|\d{1,3}\.|\(\d{1,3}\))\s+"
DELTA = r"(?i)(?:Δ|\\Delta\s|change|gain|increase|decrease)[^.;\n]{0,40}?([+-]?\d+\.?\d*)\s*(?:points?|pts?)?"
EFFECT_SIZE = r"(?i)(?:Cohen[''']s\s*)?[dgη]\s*[=:]\s*([+-]?\d+\.\d+)"
P_VALUE = r"(?i)\bp\s*[<≤=]\s*(0\.\d+|\.\d+)"
ARXIV = (r"^(\d{4}\.\d{4,5})(v\d+)?$", r"arxiv\.org/abs/(\d{4}\.\d{4,5})(v\d+)?", r"arxiv\.org/pdf/(\d{4}\.\d{4,5})(v\d+)?")
STOPWORDS = (
    "a an the and or but if then for of in on to from with by as is are was were be been being this that these those it its their them they we you i he she his her our your my "
    "not no nor so do does did done has have had having can could should would may might must will shall about into onto upon over under between among across without within"
).split()
FIGURE_STOP = "the a an of and for in on to with from is are was were by at as shows showing shown each this that their its during between".split()
EM_DASH, EN_DASH = "—", "–"
PLOS_JOURNALS = {"pone": "plosone", "pbio": "plosbiology", "pmed": "plosmedicine", "pntd": "plosntds", "ppat": "plospathogens", "pgen": "plosgenetics", "pcbi": "ploscompbiol"}


def truthy(c: Column) -> Column:
    """Not null, and not the empty string: what counts as a filled text field."""
    return F.coalesce(c != "", F.lit(False))


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it: lambdas of arrays know no common subexpressions."""
    return F.get(F.transform(F.array(value), then), 0)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without a match or where the group has no part in it."""
    return none_if_empty(F.regexp_extract(text, pattern, group))


# identifiers and slugs


def normalize_doi(raw: Column) -> Column:
    """A DOI without resolver prefix and trailing marks, lowered; empty unless it starts with 10."""
    bare = F.lower(F.btrim(F.regexp_replace(F.btrim(F.coalesce(raw, F.lit(""))), r"(?i)^https?://(?:dx\.)?doi\.org/", ""), F.lit(" .;,")))
    return F.when(bare.startswith("10."), bare).otherwise("")


def extract_dois(text: Column) -> Column:
    """Distinct lowered DOIs in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOI), F.lit(0))
    return F.array_distinct(F.transform(found, lambda d: F.lower(F.rtrim(d, F.lit(".,;)")))))


def slugify_fetch(s: Column) -> Column:
    """Lowered runs of a-z and 0-9 joined by dashes; ``unknown`` if nothing is left."""
    out = F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(none_if_empty(out), F.lit("unknown"))


def slugify_chapter(s: Column, most: int = 40) -> Column:
    """Letters of any script, digits, dashes; ``section`` if nothing is left."""
    kept = F.regexp_replace(F.lower(s), r"(?U)[^\w\s-]", "")
    out = F.rtrim(F.substring(F.btrim(F.regexp_replace(kept, r"(?U)\s+", "-"), F.lit("-")), 1, most), F.lit("-"))
    return F.coalesce(none_if_empty(out), F.lit("section"))


def slugify_key(s: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^A-Za-z0-9]+", ""), 1, 30)


def arxiv_id(source: Column) -> Column:
    """The arXiv number of an id, abstract or PDF address, without its version."""
    return F.coalesce(*(first_group(source, p) for p in ARXIV))


def page_id(path: Column) -> Column:
    return F.replace(path, F.lit(".md"), F.lit(""))


def edge_id(src: Column, dst: Column, kind: Column) -> Column:
    return F.concat(src, F.lit("->"), dst, F.lit(":"), kind)


def short_sha256(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def query_hash(text: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.btrim(text)).cast("binary")), 1, 16)


# counts and tokens


def word_count(body: Column) -> Column:
    return F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"(?U)\w+"))


def depth_label(n: Column) -> Column:
    """Depth class by words; the limits are fixed values."""
    return F.when(n < 500, "stub").when(n < 1500, "page").otherwise("chapter")


def tokens(text: Column) -> Column:
    """Distinct lowered words of three letters or more without stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z\-]{2,}"), F.lit(0)), lambda w: F.lower(w))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS)))


def title_words(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"(?U)\w{4,}"), F.lit(0)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common members over the smaller set's size; 0 if either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Common members over all members; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ > 0, both / all_).otherwise(F.lit(0.0))


def title_overlap(a: Column, b: Column) -> Column:
    return overlap_coefficient(title_words(a), title_words(b))


# pages


def loose_links(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LOOSE_LINK), F.lit(1))


def strict_links(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(STRICT_LINK), F.lit(1))


def frontmatter_type(content: Column) -> Column:
    """The first ``type:`` line anywhere, quotes dropped; ``unknown`` without one."""
    return F.coalesce(none_if_empty(F.btrim(F.regexp_extract(content, r"(?md)^type:\s*(\S+)", 1), F.lit("\"'"))), F.lit("unknown"))


def title_line(content: Column, stem: Column) -> Column:
    """The first ``title:`` line anywhere without quotes, else the stem."""
    found = F.btrim(F.btrim(F.regexp_extract(content, r"(?md)^title:\s*\"?([^\"\n]+)\"?\s*$", 1)), F.lit("\"'"))
    return F.coalesce(none_if_empty(found), stem)


def preview(body: Column, lines: int = 3, most: int = 220) -> Column:
    """The first lines that aren't blank, joined, cut."""
    kept = F.filter(F.split(body, "\n"), lambda x: F.btrim(x) != "")
    return F.substring(F.array_join(F.transform(F.slice(kept, 1, lines), lambda x: F.btrim(x)), " "), 1, most)


def section(body: Column, header: str) -> Column:
    """Text below the first ``## header`` line up to the next second-level heading; null without one."""
    quoted = "".join(f"\\{c}" if c in r"\^$.|?*+()[]{}-/" else c for c in header)
    pattern = rf"(?msd)^##[ \t]+{quoted}[ \t]*$\n?(.*?)(?=^##\s|\z)"
    return F.when(body.rlike(rf"(?md)^##[ \t]+{quoted}[ \t]*$"), F.regexp_extract(body, pattern, 1))


def sections(body: Column) -> Column:
    """(head, text) of every second-level heading in order: one pass over the body for all sections that are asked for."""
    parts = F.split(body, r"(?md)^##(?=\s)")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    head = lambda p: F.when(p.rlike(r"\A[ \t]"), F.btrim(F.substring_index(p, "\n", 1), F.lit(" \t"))).otherwise("")
    text = lambda p: F.when(F.instr(p, "\n") > 0, F.substring(p, F.instr(p, "\n") + 1, F.length(p))).otherwise("")
    return F.transform(rest, lambda p: F.struct(head(p).alias("head"), text(p).alias("text")))


def section_of(all_: Column, header: str) -> Column:
    """The first section of ``sections`` with a heading, as ``section`` gives it."""
    return F.get(F.filter(all_, lambda s: s["head"] == header), 0)["text"]


def references_block(body: Column) -> Column:
    """All below the first heading that names references; empty without one."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n")

    def heads(x: Column) -> Column:
        h = F.rtrim(F.lower(F.btrim(F.ltrim(F.btrim(x), F.lit("#")))), F.lit(":."))
        named = F.lit(False)
        for name in REFERENCE_HEADERS:
            named = named | (h == name) | h.startswith(name + " ")
        return F.btrim(x).startswith("#") & named

    at = F.array_position(F.transform(lines, heads), True)
    return F.when(at > 0, F.array_join(F.slice(lines, (at + 1).cast("int"), F.greatest(F.size(lines) - at, F.lit(0)).cast("int")), "\n")).otherwise("")


def body_before_references(body: Column) -> Column:
    """The part of a body that ``references_block`` leaves."""
    block = references_block(body)
    return F.when(F.length(block) > 0, F.substring(body, F.lit(1), F.length(body) - F.length(block))).otherwise(F.coalesce(body, F.lit("")))


def dash_counts(text: Column) -> Column:
    """(em, en): banned dashes of a text."""
    return F.struct(F.regexp_count(text, F.lit(EM_DASH)).alias("em"), F.regexp_count(text, F.lit(EN_DASH)).alias("en"))


def without_dashes(text: Column, markdown: Column | bool = True) -> Column:
    """Em dashes with the blanks around become `` - ``; in Markdown en dashes become hyphens."""
    out = F.regexp_replace(text, rf"[ \t]*{EM_DASH}[ \t]*", " - ")
    return F.when(F.lit(markdown) if isinstance(markdown, bool) else markdown, F.replace(out, F.lit(EN_DASH), F.lit("-"))).otherwise(out)


def rewrite_links(text: Column, old: str, new: str) -> Column:
    """``[[old]]`` to ``[[new]]``, suffixes after # or | kept."""
    quoted = "".join(f"\\{c}" if not c.isalnum() else c for c in old)
    return F.regexp_replace(text, rf"\[\[{quoted}([#|][^\]]*)?\]\]", f"[[{new}$1]]")


def remove_link(line: Column, slug: str, strict: bool = False) -> Column:
    """The line without its link to a page; null if nothing is left, or if strict and the bullet held only that link."""
    token = f"[[{slug}]]"
    found = loose_links(line)
    sole = F.ltrim(line).startswith("- ") & (F.size(found) == 1) & (F.get(found, 0) == slug)
    soft = F.replace(line, F.lit(token), F.lit(""))
    page = F.regexp_extract(soft, r"\(\s*p\.\s*[?\d]+\s*\)\s*", 0)
    cut = F.instr(soft, page)
    soft = F.when(F.length(page) > 0, F.concat(F.substring(soft, F.lit(1), cut - 1), F.substring(soft, cut + F.length(page), F.length(soft)))).otherwise(soft)
    soft = F.rtrim(F.regexp_replace(F.regexp_replace(soft, r"\s+,\s+,", ", "), r"\s+", " "), F.lit(", "))
    left = F.when(F.btrim(soft, F.lit("- ")) != "", soft)
    return F.when(~line.contains(token), line).when(F.lit(strict) & sole, F.lit(None)).otherwise(left)


# numbers, effects, scores


def as_int(c: Column) -> Column:
    """A whole number if the trimmed text is one, else null."""
    s = F.btrim(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))


def effect_delta(text: Column) -> Column:
    return first_group(text, DELTA)


def effect_size(text: Column) -> Column:
    return first_group(text, EFFECT_SIZE)


def p_value(text: Column) -> Column:
    return first_group(text, P_VALUE)


def first_year(text: Column) -> Column:
    return first_group(text, r"(\d{4})").try_cast("int")


def velocity(citations: Column, year: Column, as_of: int) -> Column:
    """Citations a year since publication, at least one year."""
    return citations / F.greatest(F.lit(1), F.lit(as_of) - F.coalesce(year, F.lit(as_of)))


def composite_score(co: Column, vel: Column, h: Column) -> Column:
    return co * 100 + vel + F.log10(F.greatest(F.lit(1), F.coalesce(h, F.lit(0))).cast("double"))


def forward_passes(co: Column, vel: Column, year: Column, h: Column, as_of: int, min_co: int = 2, min_velocity: float = 2.5, min_h: int = 30) -> Column:
    """Candidates without a year fail, those of this year need co-citations, others co-citations or speed in a good venue."""
    many = co >= min_co
    return F.when(year.isNull(), F.lit(False)).when(year >= as_of, many).otherwise(many | ((vel >= min_velocity) & (F.coalesce(h, F.lit(0)) >= min_h)))


def version_rank(version: Column) -> Column:
    kind = F.regexp_replace(F.lower(F.coalesce(version, F.lit(""))), "[-_]", "")
    return F.when(kind == "publishedversion", 3).when(kind == "acceptedversion", 2).when(kind == "submittedversion", 1).otherwise(0)


def publisher_url(doi: Column) -> Column:
    """The PDF address that a publisher's DOI prefix implies, else null. Prefixes and addresses are fixed values."""
    journal = F.regexp_extract(doi, r"^10\.1371/journal\.([a-z]+)\.\d+$", 1)
    name = F.coalesce(*(F.when(journal == k, F.lit(v)) for k, v in PLOS_JOURNALS.items()), F.lit("plosone"))
    elife = F.regexp_extract(doi, r"(?i)^10\.7554/eLife\.(\d+)$", 1)
    tail = F.get(F.split(doi, "/"), 1)
    return (
        F.when(journal != "", F.concat(F.lit("https://journals.plos.org/"), name, F.lit("/article/file?id="), doi, F.lit("&type=printable")))
        .when(elife != "", F.concat(F.lit("https://cdn.elifesciences.org/articles/"), elife, F.lit("/elife-"), elife, F.lit(".pdf")))
        .when(doi.startswith("10.3390/"), F.concat(F.lit("https://www.mdpi.com/article/"), doi, F.lit("/pdf")))
        .when(doi.startswith("10.3389/"), F.concat(F.lit("https://www.frontiersin.org/articles/"), doi, F.lit("/pdf")))
        .when(doi.startswith("10.2196/"), F.concat(F.lit("https://www.jmir.org/api/download?filename="), tail, F.lit(".pdf&alt_name="), tail))
    )


def authors_display(authors: Column) -> Column:
    """The first three authors, with ``et al.`` if there are more."""
    return F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " et al.").otherwise(""))


def inferred_type(kind: Column, confidence: Column) -> Column:
    """The edge's type, else by its confidence (0.7 without one)."""
    return F.coalesce(kind, F.when(F.coalesce(confidence, F.lit(0.7)) >= 0.7, "INFERRED").otherwise("AMBIGUOUS"))


def severity_range(text: Column, pattern: str) -> Column:
    """(low, high) of the first match's two groups, in order."""
    a, b = (first_group(text, pattern, k).try_cast("double") for k in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def recovered_json(text: Column) -> Column:
    """The outermost object or array of a model's answer, fences dropped; null if none."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.coalesce(first_group(bare, r"(?s)(\{.*\})"), first_group(bare, r"(?s)(\[.*\])"))


def index_match(title: Column, question: str) -> Column:
    """Whether a title bears on a question: a word of over two letters, or a pair with a CJK letter, stands in it."""
    q = F.lit(question.lower())
    low = F.lower(title)
    words = F.exists(F.split(F.btrim(low), r"\s+"), lambda w: (F.length(w) > 2) & q.contains(w))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2)))
    cjk = F.exists(pairs, lambda p: (F.length(p) == 2) & p.rlike("[一-鿿]") & q.contains(p))
    return F.when(title.rlike("[一-鿿]"), cjk).otherwise(words)


def bibtex(slug: Column, fm: dict[str, Column]) -> Column:
    """One entry; ``fm`` has key, title, authors, tags, degree, university, journal, year, doi, pdf."""
    thesis = F.coalesce(F.array_contains(fm["tags"], "thesis"), F.lit(False)) | truthy(fm["degree"])

    def field(name: str, value: Column) -> Column:
        return F.when(truthy(value), F.concat(F.lit(f"{name:8s} = {{"), value, F.lit("}")))

    rows = [
        field("author", F.array_join(fm["authors"], " and ")),
        field("title", F.translate(fm["title"], "{}", "")),
        F.when(thesis, field("school", fm["university"])),
        F.when(thesis & truthy(fm["degree"]), F.concat(F.lit("type     = {"), fm["degree"], F.lit(" thesis}"))),
        F.when(~thesis, field("journal", fm["journal"])),
        field("year", fm["year"].cast("string")),
        field("doi", fm["doi"]),
        F.when(truthy(fm["pdf"]), F.concat(F.lit("note     = {PDF: "), fm["pdf"], F.lit("}"))),
    ]
    body = F.array_join(F.array_compact(F.array(*rows)), ",\n  ")
    return F.concat(F.when(thesis, "@phdthesis").otherwise("@article"), F.lit("{"), F.coalesce(none_if_empty(fm["key"]), slug), F.lit(",\n  "), body, F.lit("\n}"))


def primary_type(family: Column, methods: Column, domain: Column) -> Column:
    """(category, label) that a source is filed under."""
    pick = lambda cat, label: F.struct(F.lit(cat).alias("category"), label.alias("label"))
    return (
        F.when(truthy(family) & (family != "none"), pick("intervention", family))
        .when(F.size(methods) > 0, pick("method", F.get(methods, 0)))
        .when(F.size(domain) > 0, pick("concept", F.get(domain, 0)))
        .otherwise(pick("source", F.lit("uncategorized")))
    )


def normalized(s: Column) -> Column:
    return F.replace(F.lower(F.btrim(F.coalesce(s, F.lit("")))), F.lit("_"), F.lit("-"))
