import random

from pyspark.sql import functions as F

from quillspark.functions import python as P
from quillspark.functions import text as X
from quillspark.operators import analyze, citations, duplicates, relations


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_doi_and_titles(spark):
    assert one(spark, X.normalize_doi(F.col("a")), a=" https://dx.doi.org/10.1/AB.; ") == "10.1/ab"
    assert one(spark, X.normalize_doi(F.col("a")), a="11.1/x") == ""
    assert one(spark, X.title_overlap(F.col("a"), F.col("b")), a="Gap junction study", b="the study") == 1.0
    assert abs(one(spark, P.sequence_ratio("a", "b"), a="gap junction", b="gap junctions") - 0.96) < 1e-9
    assert one(spark, P.norm_title("a"), a="Étude: l'Été!") == "etude l ete"


def test_effects(spark):
    t = "Score gain of 4.5 points, d = 0.62, p < 0.01"
    assert [one(spark, f(F.col("a")), a=t) for f in (X.effect_delta, X.effect_size, X.p_value)] == ["4.5", "0.62", "0.01"]
    assert one(spark, X.effect_size(F.col("a")), a="threshold: 0.05") == "0.05"
    assert one(spark, X.effect_delta(F.col("a")), a="No numbers here") is None


def test_forward_filter(spark):
    cases = [(2, 10, 2023, 0, True, 203.3333), (1, 30, 2020, 40, True, 106.6021), (1, 30, 2020, 20, False, 106.3010), (1, 99, 2026, 90, False, 200.9542), (3, 0, None, 50, False, 301.6990)]
    df = spark.createDataFrame(cases, "co int, c int, year int, h int, ok boolean, score double")
    vel = X.velocity(F.col("c"), F.col("year"), 2026)
    out = df.select("ok", "score", X.forward_passes(F.col("co"), vel, F.col("year"), F.col("h"), 2026).alias("got"), X.composite_score(F.col("co"), vel, F.col("h")).alias("s")).collect()
    assert all(r["ok"] == r["got"] and abs(r["score"] - r["s"]) < 1e-3 for r in out)


def test_greedy_references(spark):
    block = "\n".join(["# Title", "## References", "[1] Roe A. First paper on things. J One. 2001. doi:10.1000/a1.", "[2] Poe B. Second paper on things. J Two 2002. 10.1000/A1 10.1000/b2", "[3] Moe C. Third paper without any identifier. J Three 2003.", "[4] Self D. The own paper listed here once. 10.1000/own", "[5] Short. 10.1000/zz"])
    df = spark.createDataFrame([("s", "10.1000/own", block)], "slug string, own_doi string, body string")
    rows = df.select("slug", "own_doi", relations.reference_entries(X.references_block(F.col("body"))).alias("entries"))
    assert rows.select(F.size("entries")).first()[0] == 4
    r = relations.resolve_references(rows).first()
    assert r["cites"] == ["10.1000/a1", "10.1000/b2"] and len(r["cites_unresolved"]) == 2


def test_reference_splits(spark):
    body = "## Bibliography:\nA first entry that is long enough to be kept.\n\nA second one over\ntwo lines that is kept as well."
    df = spark.createDataFrame([(body,)], "b string").select(relations.reference_entries(X.references_block(F.col("b"))).alias("e"))
    assert df.first()["e"] == ["A first entry that is long enough to be kept.", "A second one over two lines that is kept as well."]


def test_section_and_links(spark):
    body = "## A\none\n## B x\ntwo\n## A\nthree"
    assert one(spark, X.section(F.col("a"), "A"), a=body).strip() == "one"
    assert one(spark, X.section(F.col("a"), "C"), a=body) is None
    assert one(spark, X.rewrite_links(F.col("a"), "x.y", "z"), a="[[x.y]] [[x.y|n]] [[xzy]]") == "[[z]] [[z|n]] [[xzy]]"
    assert one(spark, X.remove_link(F.col("a"), "s", True), a="- [[s]] (p. 3) - text") is None
    assert one(spark, X.remove_link(F.col("a"), "s"), a="- [[s]] (p. 3) and [[t]]") == "- and [[t]]"
    assert one(spark, X.without_dashes(F.col("a")), a="a — b 1–2") == "a - b 1-2"


def test_chapters(spark):
    body = "preamble\n# Chapter 2: Aims\n" + "x" * 20 + "\n# References\n" + "y" * 20 + "\n# III. Results\nz\n"
    df = spark.createDataFrame([("t", body)], "page_id string, body string")
    got = [(r["number"], r["title"]) for r in relations.chapters(df, least=5).orderBy("ord").collect()]
    assert got == [(2, "Aims"), (3, "references"), (3, "Results")]


def test_figures(spark):
    body = "![a](img/p1.png)\n12\n![b](img/p2.png)\n\nFigure 3. A caption that is long enough\n![c](img/p3.png)\nText\n"
    df = spark.createDataFrame([("s", body)], "page_id string, body string")
    got = sorted((r["image_id"], r["fig"], r["part"]) for r in relations.figure_captions(df).collect())
    assert got == [("p1.png", "3", "p1"), ("p2.png", "3", "p2")]


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["gap", "junction", "signal", "timing", "probe", "alpha"]
    pick = lambda k: [rng.choice(words) for _ in range(rng.randint(0, k))]
    data = [("c", f"s{i}", f"{i:03d}", " ".join(pick(3)) or f"t{i}", pick(1), pick(2), " ".join(pick(5))) for i in range(40)]
    pages = spark.createDataFrame(data, "kind string, slug string, path string, title string, aliases array<string>, tags array<string>, body string")
    refs = spark.createDataFrame([(f"s{i}", sorted(set(pick(2)))) for i in range(0, 40, 2)], "target string, referrers array<string>")
    rows = duplicates.features(pages, refs)
    got = {(r["a"], r["b"]) for r in duplicates.kept(duplicates.scored_pairs(duplicates.candidate_pairs(rows), rows)).select("a", "b").collect()}
    all_ = rows.select(F.col("path").alias("a"), *(F.col(c).alias(f"{c}1") for c in ("alias", *duplicates.SETS))).crossJoin(rows.select(F.col("path").alias("b"), *(F.col(c).alias(f"{c}2") for c in ("alias", *duplicates.SETS)))).where("a < b")
    pairs = all_.select(F.lit("c").alias("kind"), "a", "b", *(F.size(F.array_intersect(f"{c}1", f"{c}2")).alias(f"common_{c}") for c in ("alias", *duplicates.SETS)))
    want = {(r["a"], r["b"]) for r in duplicates.kept(duplicates.scored_pairs(pairs, rows)).select("a", "b").collect()}
    assert got == want and want


def test_best_version(spark):
    rows = [("d", 1, 0, "p1", "u1", "submittedVersion", True), ("d", 2, 0, "p2", "u2", "acceptedVersion", True), ("d", 3, 0, "p3", "u3", "publishedVersion", True), ("e", 1, 0, "p1", "v", "submittedVersion", True)]
    df = spark.createDataFrame(rows, "doi string, provider_ord int, cand_ord int, provider string, url string, version string, verified boolean")
    assert {r["doi"]: (r["url"], r["final"]) for r in citations.best_version(df).collect()} == {"d": ("u2", True), "e": ("v", False)}


def test_metrics(spark):
    tracts = spark.createDataFrame([(0, "CST", r"\bcst\b")], "ord int, label string, pattern string")
    df = spark.createDataFrame([("a", "In the CST the FA was = 0.45 ± 0.05; FA (=) 1.45")], "slug string, body string")
    got = [tuple(r) for r in analyze.metric_observations(df, {"FA": ["fractional anisotropy", "FA was"]}, tracts).select("tract", "metric", "value", "sd").collect()]
    assert got == [("CST", "FA", 0.45, 0.05)]


def test_sections_equal_the_pattern(spark):
    """All sections in one pass give what the pattern for each heading gives."""
    from pyspark.sql import functions as F

    from quillspark.functions import text as X

    parts = ["## A", "##  A \t", "##\tB", "### A", "##A", "##", "text", "", "## A b", "##\r", "## B\r", " ## A", "##\n## A"]
    bodies = ["\n".join(parts[(i * k) % len(parts)] for k in range(1, 9)) + "\n" * (i % 2) for i in range(40)] + ["", "## A", "## A\n"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    found = X.sections(F.col("body"))
    for h in ("A", "B", "A b"):
        rows = df.select("body", X.section(F.col("body"), h).alias("want"), X.section_of(found, h).alias("got")).collect()
        assert [r for r in rows if r["want"] != r["got"]] == []
        assert any(r["want"] for r in rows)
