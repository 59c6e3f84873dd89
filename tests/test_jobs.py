"""The jobs on growing and odd input, run again and after a failure, and from the command line."""

import json
import os
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(__file__))
SMALL = "/root/testdata/sf0.001"
CONFIG = {"id": "doc_id", "kind": "lang", "text": "text", "least_sentence": 20, "files_per_batch": 1000}
SCHEMA = "doc_id long, text string, lang string, batch int, changed string"


def put(spark, folder, name, rows):
    """One more Parquet file."""
    part = f"{folder}-{name}"
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).coalesce(1).write.parquet(part)
    os.makedirs(folder, exist_ok=True)
    (made,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
    os.rename(f"{part}/{made}", f"{folder}/{name}.parquet")


def state(spark, out):
    from jobs.page_index import coverage, in_force, versions

    pages = {r["page_id"]: (r["kind"], r["n_words"], r["depth"], r["versions"]) for r in in_force(versions(spark, out)).collect()}
    return pages, {(r["kind"], r["depth"]): (r["n"], r["share"]) for r in coverage(spark, out).collect()}


def test_page_index_takes_only_what_is_new(spark, tmp_path):
    from jobs.page_index import run, versions

    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    long = "A sentence of some length here. " * 300
    put(spark, source, "a", [(1, "one two", "en"), (2, long, "en"), (3, None, "de"), (None, "no id", ""), (4, "see [[Page]] and doi 10.1000/x.", None)])
    assert run(spark, source, out, mark, CONFIG) == {"batches": 1, "read": 5, "written": 5}
    pages, shares = state(spark, out)
    assert pages == {"1": ("en", 2, "stub", 1), "2": ("en", 1800, "chapter", 1), "3": ("de", 0, "stub", 1), None: ("none", 2, "stub", 1), "4": ("none", 7, "stub", 1)}
    assert shares == {("en", "stub"): (1, 50.0), ("en", "chapter"): (1, 50.0), ("de", "stub"): (1, 100.0), ("none", "stub"): (2, 100.0)}
    four = versions(spark, out).where("page_id = '4'").first()
    assert (four["n_links"], four["n_dois"], four["n_sentences"]) == (1, 1, 1)

    # nothing new: nothing is read or written
    assert run(spark, source, out, mark, CONFIG) == {"batches": 0, "read": 0, "written": 0} and state(spark, out) == (pages, shares)

    # the same page again, a rewritten one, one of another kind, a new one
    put(spark, source, "b", [(1, "one two", "en"), (2, "short now", "en"), (3, None, "fr"), (5, "new", "de"), (None, "no id", "")])
    assert run(spark, source, out, mark, CONFIG) == {"batches": 1, "read": 5, "written": 3}
    pages, shares = state(spark, out)
    assert pages["1"][3] == 1 and pages["2"] == ("en", 2, "stub", 2) and pages["3"] == ("fr", 0, "stub", 2) and pages["5"] == ("de", 1, "stub", 1)
    assert shares == {("en", "stub"): (2, 100.0), ("fr", "stub"): (1, 100.0), ("de", "stub"): (1, 100.0), ("none", "stub"): (2, 100.0)}

    # back to an earlier text, and two versions in one batch of which the file that came later wins
    put(spark, source, "c", [(2, long, "en"), (6, "first", "en")])
    put(spark, source, "d", [(6, "then this", "en")])
    at = os.path.getmtime(f"{source}/c.parquet")
    os.utime(f"{source}/d.parquet", (at + 5, at + 5))
    assert run(spark, source, out, mark, CONFIG)["written"] == 2
    pages, _ = state(spark, out)
    assert pages["2"] == ("en", 1800, "chapter", 3) and pages["6"] == ("en", 2, "stub", 1)


def test_page_index_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch that fails when it has written is run again and writes the same."""
    from jobs import page_index

    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, source, "a", [(k, f"text {k}", "en") for k in range(20)])
    put(spark, source, "b", [(k, f"text {k} again", "en") for k in range(10, 30)])
    one = CONFIG | {"files_per_batch": 1}
    whole, calls = page_index.versions, []

    def failing(spark, output):
        calls.append(1)
        if len(calls) == 4:  # in the second batch, after its write
            raise OSError("lost")
        return whole(spark, output)

    monkeypatch.setattr(page_index, "versions", failing)
    with pytest.raises(Exception, match="lost"):
        page_index.run(spark, source, out, mark, one)
    monkeypatch.undo()
    page_index.run(spark, source, out, mark, one)
    got = state(spark, out)
    page_index.run(spark, source, f"{out}2", f"{mark}2", one)
    assert got == state(spark, f"{out}2") and len(got[0]) == 30 and whole(spark, out).count() == 40


def test_page_index_of_nothing(spark, tmp_path):
    from jobs.page_index import run

    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    assert run(spark, source, out, mark, CONFIG)["written"] == 0
    assert state(spark, out) == ({}, {})


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_page_index_from_the_command_line(spark, tmp_path):
    """Twice, over a copy of the table that grows in between, as two runs of the program."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part, said in (("doc_id < 120", b"wrote 120 versions"), ("doc_id >= 110", b"wrote 80 versions")):
        docs.where(part).write.mode("append").parquet(source)
        done = subprocess.run([sys.executable, "-m", "jobs.page_index", "--input", source, "--output", out, "--checkpoint", str(tmp_path / "mark")], cwd=TOP, capture_output=True, timeout=300)
        assert done.returncode == 0 and said in done.stderr, done.stderr[-2000:]
    pages, shares = state(spark, out)
    assert len(pages) == 200 and all(p[3] == 1 for p in pages.values()) and sum(n for n, _ in shares.values()) == 200


PAGES = "page_id string, url string, html string, kind string, links int"


def html(title, links, lang="en"):
    return f'<html lang="{lang}"><title>{title} of it</title>' + "".join(f'<a href="/{x}">x</a>' for x in links)


def tables(spark, out):
    from jobs.link_tables import TABLES, table

    return {name: sorted(map(repr, table(spark, out, name).collect())) for name in TABLES}


def test_link_tables(spark, tmp_path):
    from jobs.link_tables import run, table

    config = json.loads(open(f"{TOP}/jobs/link_tables.json").read())
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", "u", html("A", ["b", "B", "gone", "gone"]), "k", 1), ("b", None, html("B", ["a", "b"], "de"), None, 1), ("c", "u", None, "k", 1), ("d", "u", html("b", ["gone", "Gone"]), "k", 1), ("e", "u", "", "", 0)]
    spark.createDataFrame(rows, PAGES).write.parquet(source)
    assert run(spark, source, out, config) == {"parsed": 5, "nodes": 5, "edges": 3, "broken": 2}
    first = tables(spark, out)
    assert {(r["from"], r["to"], r["kind"]) for r in table(spark, out, "edges").collect()} == {("a", "d", "en"), ("b", "a", "de"), ("b", "d", "de")}
    nodes = {r["page_id"]: (r["n_in"], r["n_out"], r["degree"], r["standing"], r["kind"]) for r in table(spark, out, "nodes").collect()}
    assert nodes == {"a": (1, 1, 2, "page", "en"), "b": (0, 2, 2, "page", "de"), "c": (0, 0, 0, "orphan", "none"), "d": (2, 0, 2, "page", "en"), "e": (0, 0, 0, "orphan", "none")}
    assert {(r["target"], r["n_pages"], r["n_links"]) for r in table(spark, out, "broken").collect()} == {("gone", 2, 3), ("Gone", 1, 1)}
    run(spark, source, out, config)
    assert tables(spark, out) == first
    spark.createDataFrame([], PAGES).write.mode("overwrite").parquet(source)
    assert set(run(spark, source, out, config).values()) == {0}


def test_link_tables_from_the_command_line(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "u", html("A", ["a", "x"]), "k", 1)], PAGES).write.parquet(source)
    done = subprocess.run([sys.executable, "-m", "jobs.link_tables", "--input", source, "--output", out], cwd=TOP, capture_output=True, timeout=300)
    assert done.returncode == 0 and b"read 1 pages" in done.stderr, done.stderr[-2000:]
    assert len(tables(spark, out)["broken"]) == 1


def test_shared_folder_needs_a_name_on_a_cluster():
    from types import SimpleNamespace as N

    from quillspark.session import shared_folder

    unset = N(get=lambda *_: "")
    cluster = N(conf=unset, sparkContext=N(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(ValueError):
        shared_folder(cluster, "x")
