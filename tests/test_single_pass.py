"""Work that is done once for each row, and files that don't grow with every hundred rows."""

import contextlib
import io
from pathlib import Path

from pyspark.sql import functions as F

from quillspark import file_queries, wiki_queries  # noqa: F401  they register queries
from quillspark.operators import analyze, relations
from quillspark.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain(True)
    return said.getvalue().split("== Physical Plan ==")[1]


def test_heading_is_worked_out_once(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["# Chapter 12: A title.\n", "  # IV. Part \n", "# **General Discussion**", "# Partie ix - La fin", "# Étude 3 : x", "# \n", "## Chapter 1", "# 4", "text", "# Chapter 0 - zero"])], "k int, line string")
    heads = rows.select("k", relations.chapter_heading(F.col("line")).alias("h"))
    got = {r["k"]: tuple(r["h"]) for r in heads.collect() if r["h"]}
    assert got == {0: (12, "A title"), 1: (4, "Part"), 2: (None, "general discussion"), 3: (9, "La fin"), 4: (3, "x"), 9: (0, "zero")}
    assert plan(heads).lower().count("regexp_extract(") <= 2 * len(relations.CHAPTER_PATTERNS)


def test_thesis_rows_are_dealt(spark):
    assert QUERIES["thesis_chapters"](spark, SF).rdd.getNumPartitions() > 1


def test_references_are_picked_once(spark):
    entries = spark.createDataFrame([("s", "10.1/own", ["a 10.1234/x", "b 10.1234/x 10.1234/y", "c 10.1234/x"])], "slug string, own_doi string, entries array<string>")
    out = relations.resolve_references(entries)
    r = out.first()
    assert (r["cites"], r["cites_unresolved"]) == (["10.1234/x", "10.1234/y"], ["c 10.1234/x"])
    assert plan(out).count("array_contains(") <= 4


def test_tracts_need_no_shuffle(spark):
    tracts = spark.createDataFrame([(1, "Arcuate", r"\barcuate\b"), (0, "Any", r"fascic\w+"), (2, "Late", r"\bfasciculus\b")], "ord int, label string, pattern string")
    rows = spark.createDataFrame([("a", "the arcuate fasciculus FA = 0.4"), ("b", "Arcuate: FA = 0.5"), ("b", "nothing: FA 0.3"), ("c", None)], "slug string, body string")
    found = analyze.metric_observations(rows, {"FA": []}, tracts)
    assert sorted(((r["slug"], r["tract"] or "", r["value"]) for r in found.collect())) == [("a", "Any", 0.4), ("b", "", 0.3), ("b", "Arcuate", 0.5)]
    assert "Exchange" not in plan(found)


def test_effects_are_counted_in_one_pass(spark):
    assert plan(QUERIES["effects_by_outcome"](spark, SF)).count("EvalPython") == 1


def test_graph_files_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_queries, "_folder", lambda s: str(tmp_path / "graphs"))
    assert QUERIES["graph_snapshot_edges"](spark, "/root/testdata/sf0.01").count() == 1500
    assert len(list(Path(tmp_path, "graphs").rglob("*.txt"))) == 1
