"""Streams that remember: the graph kept by changes against a full build, and hits reported once against a plain loop."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from quillspark.streaming import graph_changes as G
from quillspark.streaming import seen


def _full(changes):
    """Edges, degrees and missing names of the latest versions, by plain loops."""
    last = {}
    for page, path, stem, version, targets in changes:
        if page is None:
            continue
        stem = stem.lower() if stem is not None else None
        targets = None if targets is None else sorted({t.lower() for t in targets if t is not None})
        now = last.get(page)
        if now is None or version > now[0]:
            last[page] = (version, path, stem, targets)
    live = {p: v for p, v in last.items() if v[3] is not None}
    owner = {}
    for page, (_, path, stem, _) in live.items():
        if stem is not None:
            owner[stem] = max(owner.get(stem, (path, page)), (path, page))
    edges = {(p, owner[t][1]) for p, v in live.items() for t in v[3] if t in owner and owner[t][1] != p}
    pairs = {tuple(sorted(e)) for e in edges}
    missing = {}
    for v in live.values():
        for t in v[3]:
            if t not in owner:
                missing[t] = missing.get(t, 0) + 1
    return edges, {p: sum(p in x for x in pairs) for p in live}, missing


def _kept(spark, root):
    edges = [tuple(r) for r in G.directed_edges(spark, root).collect()]
    degrees = [tuple(r) for r in G.degrees(spark, root).collect()]
    missing = [tuple(r) for r in G.missing_names(spark, root).collect()]
    assert len(set(edges)) == len(edges) and len(dict(degrees)) == len(degrees)
    return set(edges), dict(degrees), dict(missing)


def _random_changes(seed, n=20):
    """Versions of seven pages that share four names: rewritten, renamed, moved, gone and back again."""
    rng = random.Random(seed)
    out = []
    for version in range(n):
        page = f"p{rng.randrange(7)}"
        stem = rng.choice(["A", "a", "b", "Cc", "d", None])
        targets = None if rng.random() < 0.2 else [rng.choice(["a", "B", "cc", "D", "none", None]) for _ in range(rng.randrange(5))]
        out.append((page, f"{rng.randrange(3)}/{page}", stem, version, targets))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_changes_is_a_full_build(spark, tmp_path, seed):
    changes = _random_changes(seed)
    mixed = changes[:]
    random.Random(seed + 50).shuffle(mixed)
    root = str(tmp_path / "mixed")
    G.prepare(spark, root)
    for batch in range(4):
        G.take(spark.createDataFrame(mixed[batch * 5 : batch * 5 + 5], G.CHANGES), root, batch)
        assert _kept(spark, root) == _full(mixed[: batch * 5 + 5])
    assert _kept(spark, root) == _full(changes)


def test_batches_run_again_and_sums(spark, tmp_path):
    changes = _random_changes(3)
    root, fresh = str(tmp_path / "a"), str(tmp_path / "b")
    frame = lambda rows: spark.createDataFrame(rows, G.CHANGES)
    G.prepare(spark, root)
    G.take(frame(changes[:12]), root, 0)
    G.take(frame(changes[12:]), root, 1)
    want = _full(changes)
    assert _kept(spark, root) == want
    G.take(frame(changes[12:]), root, 1)  # as after a failure
    assert _kept(spark, root) == want
    G.take(frame(changes), root, 2)  # nothing new in it
    assert _kept(spark, root) == want
    assert all(G.table(spark, root, t).where("batch = 2").isEmpty() for t in G.TABLES)
    G.compact(spark, root, fresh)
    assert _kept(spark, fresh) == want
    more = [("p1", "0/p1", "a", 99, ["b", "d"]), ("p9", None, "none", 99, [])]
    G.take(frame(more), fresh, 3)
    assert _kept(spark, fresh) == _full(changes + more)


def test_odd_changes(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, G.CHANGES)
    root = str(tmp_path / "odd")
    G.prepare(spark, root)
    G.take(frame([]), root, 0)
    assert _kept(spark, root) == (set(), {}, {})
    rows = [(None, "x", "x", 1, ["y"]), ("a", "a", "A", None, ["a", "a", "b", None]), ("b", "b", "b", None, []), ("b", "b", "b", None, [])]
    G.take(frame(rows), root, 1)
    assert _kept(spark, root) == ({("a", "b")}, {"a": 1, "b": 1}, {})
    # versions of the same number: the same one counts whichever comes first
    ties = [("a", "a", "a", 5, ["q"]), ("a", "a", "a", 5, ["r"]), ("a", "a", "a", 5, None)]
    for i, order in enumerate((ties, ties[::-1])):
        G.prepare(spark, f"{root}-{i}")
        for k, row in enumerate(order):
            G.take(frame([row]), f"{root}-{i}", k)
    assert _kept(spark, f"{root}-0") == _kept(spark, f"{root}-1")


def _report(hits, keep):
    """Each key's reports: the first hit, then the first that is ``keep`` or more after the last report."""
    out = set()
    for key in {k for k, _ in hits}:
        last = None
        for t in sorted(t for k, t in hits if k == key and t is not None):
            if last is None or t - last >= keep:
                out.add((key, t))
                last = t
    return out


def test_hits_are_reported_once_in_a_while(spark, tmp_path):
    rng = random.Random(5)
    start = datetime(2024, 3, 1, tzinfo=timezone.utc)
    at = lambda m: start + timedelta(minutes=m)
    first = [(rng.choice(["a", "b", "c", None]), at(rng.randrange(1000))) for _ in range(150)] + [("a", None)]
    # repeats of the last hour, hits after it, and a key that nobody remembers by then
    second = [h for h in first if h[1] and h[1] >= at(940)] + [(rng.choice(["a", "b", "c", None]), at(1000 + rng.randrange(900))) for _ in range(150)]
    third = [("a", at(9000)), ("z", at(9001)), ("z", at(9001))]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    provider = spark.conf.get(seen.PROVIDER)

    def run():
        stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
        seen.watch(stream, "k", "t", out, mark, 45 * 60, "2 hours").awaitTermination()
        rows = [(r["key"], r["time"].astimezone(timezone.utc)) for r in spark.read.schema("key string, time timestamp").parquet(out).collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    hits = []
    for more in (first, second, third):
        spark.createDataFrame(more, "k string, t timestamp").write.mode("append").parquet(str(tmp_path / "in"))
        hits += more
        assert run() == _report(hits, timedelta(minutes=45))
    assert run() == _report(hits, timedelta(minutes=45))  # nothing new
    assert spark.conf.get(seen.PROVIDER) == provider
