"""Bucketed names and targets: plain loops, odd pages, and plans without a shuffle."""

from quillspark.operators import linktable

PAGES = [
    ("a", "x/a", "Hub", ["One", "one", "gone", "gone"]),
    ("b", "y/b", "one", ["hub", "HUB", None, "Gone"]),
    ("c", "x/c", "ONE", ["gone"]),
    ("d", None, None, ["hub", ""]),
    ("e", "e", "", None),
    ("f", "f", "lonely", []),
    *((f"g{i}", f"g/{i}", "crowd", ["hub", "far", "far"]) for i in range(60)),
]


def _tables(spark, tmp_path, rows):
    pages = spark.createDataFrame(rows, "page_id string, path string, stem string, targets array<string>")
    return linktable.store(pages, str(tmp_path / "tables"), 4)


def test_against_loops(spark, tmp_path):
    t = _tables(spark, tmp_path, PAGES)
    names, links = {}, []
    for page, path, stem, targets in PAGES:
        if stem is not None:
            names.setdefault(stem.lower(), []).append((path, page))
        links += [(page, x) for x in targets or [] if x is not None]
    missing = {}
    for page, x in links:
        if x.lower() not in names:
            missing.setdefault(x, []).append(page)
    assert {tuple(r) for r in linktable.missing_targets(t).collect()} == {(x, len(set(p)), len(p)) for x, p in missing.items()}
    want = {(s, max(held)[1], len(held), sum(x.lower() == s for _, x in links)) for s, held in names.items()}
    assert {tuple(r) for r in linktable.named(t).collect()} == want
    linked = {x.lower() for _, x in links}
    assert {r[0] for r in linktable.unlinked_pages(t).collect()} == {p for p, _, s, _ in PAGES if s is None or s.lower() not in linked}
    broken = {(p, x, linked.count(p)) for x, linked in missing.items() for p in linked}
    assert {tuple(r) for r in linktable.broken_links(t).collect()} == broken
    assert ("total", "broken", sum(map(len, missing.values()))) in {tuple(r) for r in linktable.link_report(t).collect()}


def test_no_pages(spark, tmp_path):
    assert [tuple(r) for r in linktable.link_report(_tables(spark, tmp_path, [])).collect()] == [("total", "broken", 0)]


def test_joins_of_names_and_targets_need_no_shuffle(spark, tmp_path):
    t = _tables(spark, tmp_path, PAGES)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (linktable.missing_targets(t), linktable.named(t)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not [x for x in spark.catalog.listTables() if x.name.startswith(("names_", "targets_"))]
