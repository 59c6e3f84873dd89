"""Names by automaton against joins by pattern."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import analyze, names


def test_names_equal_patterns(spark):
    """Random texts and names with odd letters and edges, against the pattern join that they replace."""
    rng = random.Random(4)
    letters = ["a", "B", "b", "é", "É", "ß", "σ", "ς", "Σ", "1", "_", "-", "(", ")", ".", " ", " ", "́", "漢", "|", "\\"]
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [None, "", *(some(rng.randint(1, 25)) for _ in range(400))]
    wanted = sorted({some(rng.randint(1, 4)) for _ in range(150)})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lexicon = spark.createDataFrame([(str(i), "|".join(rf"\b{re.escape(x)}\b" for x in (n, n[::-1]))) for i, n in enumerate(wanted)], "key string, pattern string")
    split = lexicon.select(names.literal_names(F.col("pattern")).alias("n"))
    assert [r["n"] for r in split.collect()] == [[n, n[::-1]] for n in wanted]
    got = {(r["id"], r["key"]) for r in analyze.lexicon_hits(df, lexicon, "text").collect()}
    want = {(r["id"], r["key"]) for r in df.crossJoin(lexicon).where(F.rlike("text", F.concat(F.lit("(?iU)"), "pattern"))).collect()}
    assert got == want and len(want) > 200


def test_blocks_give_what_one_gives(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"w{k} and W{k + 1}x w{k + 2}.") for k in range(300)], "id long, text string")
    entries = spark.createDataFrame([(f"k{k % 7}", f"w{k}") for k in range(0, 300, 2)], "key string, name string")
    whole = sorted(map(tuple, names.find_names(texts, entries, "text").collect()))
    monkeypatch.setattr(names, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, names.find_names(texts, entries, "text").collect())) == whole
    assert names.find_names(texts, entries.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        names.find_names(texts.withColumn("key", F.lit(1)), entries, "text")


def test_raw_patterns_are_tried_and_counted(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a12 b"), (2, "B"), (3, None)], "id long, text string")
    lexicon = spark.createDataFrame([("n", r"\bb\b"), ("p", r"a\d+"), ("q", None), ("c", r"\ba|b\b")], "key string, pattern string")
    assert sorted((r["id"], r["key"]) for r in analyze.lexicon_hits(texts, lexicon, "text").collect()) == [(1, "c"), (1, "n"), (1, "p"), (2, "c"), (2, "n")]
    monkeypatch.setattr(analyze, "MOST_PATTERNS", 1)
    with pytest.raises(ValueError):
        analyze.lexicon_hits(texts, lexicon, "text")


def test_a_hundred_thousand_names(spark):
    """Every text holds three of them; no join by pattern is in the plan."""
    n = 100_000
    pages = spark.range(500).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("page_id"), F.lit("sources").alias("kind"), F.concat(F.lit("About ENTITY-"), "id", F.lit(", entity-"), F.col("id") + 50_000, F.lit("; entity-7.")).alias("content"))
    entities = spark.range(n).select(F.concat(F.lit("Entity-"), "id").alias("name"))
    start = time.time()
    rows = analyze.entity_contexts(pages, entities)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    got = {(r["name"], r["page_id"]) for r in rows.where("name in ('Entity-7', 'Entity-499', 'Entity-50123')").collect()}
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan
    assert ("Entity-499", "p0499") in got and ("Entity-50123", "p0123") in got and sum(x == "Entity-7" for x, _ in got) == 15
    sentences = pages.select("page_id", F.lit(0).alias("pos"), F.col("content").alias("sentence"))
    regions = entities.select(F.col("name").alias("key"), F.col("name").alias("label"), F.concat(F.lit(r"\b"), F.regexp_replace("name", "-", r"\\-"), F.lit(r"\b")).alias("pattern"))
    found = analyze.region_snippets(sentences, regions)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # whole words: entity-7 alone, not the longer names that begin so
    assert found.where("key = 'Entity-7'").count() == 500 and found.where("key = 'Entity-4'").count() == 1 and found.where("key = 'Entity-50123'").count() == 1
    assert time.time() - start < 240


def test_entity_contexts_ignores_case(spark):
    pages = spark.createDataFrame([("a", "sources", "The İZMIR straße"), ("b", "concepts", "izmir"), ("c", "methods", None), ("d", "sources", "xizmirx")], "page_id string, kind string, content string")
    entities = spark.createDataFrame([("Izmir",), ("İzmir",), ("STRAßE",), ("",), (None,)], "name string")
    low = pages.where("kind <> 'concepts'").crossJoin(entities.where("name <> ''")).where("contains(lower(content), lower(name))")
    want = {(r["name"], r["page_id"]) for r in low.collect()}
    assert {(r["name"], r["page_id"]) for r in analyze.entity_contexts(pages, entities).collect()} == want


def test_word_bounds_of_ascii_or_of_any_letters(spark):
    """An accented letter is no word bound, but for patterns with ASCII words, as names and as patterns."""
    from quillspark.operators.analyze import lexicon_hits

    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["un avecé", "éavec", "avec", "avecs", "xavec", "à avec, là", "avec_"])], "id int, t string")
    for pattern in (r"\bavec\b", r"\b(?:avec)\b"):
        lexicon = spark.createDataFrame([("k", pattern)], "key string, pattern string")
        hits = lambda **o: sorted(r["id"] for r in lexicon_hits(texts, lexicon, "t", **o).collect())  # noqa: E731, B023
        assert hits() == [2, 5]
        assert hits(ascii_words=True) == [0, 1, 2, 5]


def test_families_are_dealt_before_they_are_counted(spark):
    """The rows of one family are counted and cut in parts; the counts and the first rows are those of the whole."""
    rows = [("score", f"s{k % 700:04}", k) for k in range(1000)]
    found = spark.createDataFrame(rows, "outcome string, slug string, pos int")
    sources = spark.createDataFrame([(f"s{k:04}", "f" if k % 10 else "") for k in range(700)], "slug string, intervention_family string")
    out = analyze.effects_by_family(found, sources, 7)
    for family, keep in (("f", lambda s: int(s[1:]) % 10), ("none", lambda s: not int(s[1:]) % 10)):
        mine = sorted((s, p) for _, s, p in rows if keep(s))
        got = [(r["slug"], r["pos"]) for r in out.where(F.col("family") == family).orderBy("r").collect()]
        assert got == mine[:7] and {r["n"] for r in out.where(F.col("family") == family).collect()} == {len(mine)}
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert "part#" in windows[-1]
