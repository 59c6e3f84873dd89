import glob
import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


def test_entry_imports_with_a_stale_cache_folder(tmp_path):
    """Only the compiled files of the subpackage are left behind."""
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(__file__))
    shutil.copytree(os.path.join(top, "quillspark"), tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm"))
    (tmp_path / "quillspark/llm/__pycache__").mkdir(parents=True)
    shutil.copytree(os.path.join(top, "jobs"), tmp_path / "jobs")
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 120 and not [n for n in q if n.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0


def test_core_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['quillspark.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport quillspark.queries as q; assert len(q.QUERIES) > 50"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__)), timeout=120).returncode == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_queries_equal_their_sql(spark):
    import jobs.queries
    import quillspark.file_queries
    import quillspark.report_queries
    import quillspark.wiki_queries  # noqa: F401
    from quillspark.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")

    def clean(v):
        return round(v, 9) if isinstance(v, float) else v

    wrong = []
    for name, q in QUERIES.items():
        df = q(spark, SMALL)
        got = [tuple(clean(r[c]) for c in sorted(df.columns)) for r in df.collect()]
        if name in SQL:
            res = con.execute(SQL[name])
            names = [d[0] for d in res.description]
            want = [tuple(clean(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall()]
            if sorted(names) != sorted(df.columns) or sorted(map(repr, got)) != sorted(map(repr, want)):
                wrong.append(name)
    assert not wrong


def test_stream_refresh(spark, tmp_path):
    from quillspark.streaming.incremental import changed_pages, refresh

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("one")
    seen = []
    run = lambda: refresh(changed_pages(spark, str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / "cp"), lambda df: seen.extend(r["content"] for r in df.collect())).awaitTermination(60)
    run()
    (tmp_path / "in/b.md").write_text("two")
    run()
    assert seen == ["one", "two"]
