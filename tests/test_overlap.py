"""Overlap pairs against all pairs, and how many meet."""

import random
import re

import pytest

from quillspark.operators.overlap import overlap_pairs


def brute(rows, least):
    out = {}
    for g, a, x in rows:
        for h, b, y in rows:
            if g == h and a < b and x and y:
                s, t = set(x) - {None}, set(y) - {None}
                if s and t and len(s & t) >= least * min(len(s), len(t)):
                    out[g, a, b] = round(len(s & t) / min(len(s), len(t)), 9)
    return out


@pytest.mark.parametrize("least", [0.1, 0.4, 0.5, 0.9, 1.0])
def test_overlap_equals_all_pairs(spark, least):
    rng = random.Random(int(least * 10))
    rows = [(rng.choice("xy"), k, [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.choice([0, 1, 2, 3, 5, 12]))]) for k in range(150)]
    rows += [("x", 150, None), ("x", 151, ["w1", None, "w1"]), ("x", 152, ["w1"])]
    df = spark.createDataFrame(rows, "g string, id long, w array<string>")
    got = overlap_pairs(df, ["g"], "id", "w", least).collect()
    assert {(r["g"], r["a"], r["b"]): round(r["overlap"], 9) for r in got} == brute(rows, least) and len(got) > 20
    assert overlap_pairs(df.limit(0), ["g"], "id", "w", least).count() == 0


def test_a_word_that_everyone_has_joins_few(spark):
    """Two thousand sets of one common word and nine rare ones: no pair meets by the common word."""
    rows = [("x", k, ["everyone", *(f"r{k}-{i}" for i in range(8)), f"s{k // 2}"]) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, id long, w array<string>")
    assert overlap_pairs(df, ["g"], "id", "w", 0.2).count() == 1000
    met = overlap_pairs(df, ["g"], "id", "w", 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in met and "NestedLoop" not in met
    with pytest.raises(ValueError):
        overlap_pairs(df, ["g"], "id", "w", 0.0)


def test_copies_are_classes_and_pairs_are_not_shuffled(spark):
    """Five hundred copies of one set: no join reads pairs, and the whole of them is made."""
    rows = [("x", k, ["w1", "w2"]) for k in range(500)] + [("x", 500 + k, ["w2", "w3", f"s{k}"]) for k in range(20)] + [("y", 999, ["w1"]), (None, 1000, ["w1"]), (None, 1001, ["w1"])]
    df = spark.createDataFrame(rows, "g string, id long, w array<string>")
    for first in (None, 3):
        got = overlap_pairs(df, ["g"], "id", "w", 0.5, first)
        kept = rows if not first else [r for r in rows if r[1] < 3 or r[1] >= 500]
        want = brute([r for r in kept if r[0]], 0.5)
        assert {(r["g"], r["a"], r["b"]): round(r["overlap"], 9) for r in got.collect()} == want and len(want) > (250 if first else 130_000)
    out = overlap_pairs(df, ["g"], "id", "w", 0.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Exchange")[0].count("Generate explode(ids_") == 2, plan  # pairs are made behind the last shuffle


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_pairs_within_blocks(spark, monkeypatch, block):
    from quillspark.operators import overlap, relations

    monkeypatch.setattr(overlap, "BLOCK", block)
    rows = [(k % 3 if k % 7 else None, k // 2 if k % 11 else None) for k in range(120)]
    want = sorted((g, a, b) for g, a in rows for h, b in rows if g is not None and g == h and a is not None and b is not None and a < b)
    got = relations.pairs_within(spark.createDataFrame(rows, "g int, v int"), "g", "v").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("parity", [False, True])
def test_best_replications_equal_all_pairs(spark, parity):
    """The best of many copies that declare each other, against all pairs."""
    from quillspark.operators.analyze import replication_candidates

    rng = random.Random(5)
    rows = [(f"s{k:03}", rng.choice("fg"), "d", rng.choice(["adults group1", "adults group2", "adults group1 word1"]), rng.choice(["", f"10.1/{k}"]), rng.choice(["", f"10.1/{rng.randint(0, 5)}"])) for k in range(90)]
    df = spark.createDataFrame(rows, "slug string, intervention_family string, study_design string, population string, doi string, replication_of string")
    every = [(-o, f, a, b) for (f, a, b), o in brute([(r[1], r[0], r[3].split()) for r in rows], 0.4).items()]
    by = {r[0]: r for r in rows}
    said = lambda x, y: x[5] == y[4] and (parity or x[5] != "")
    want = [(a, b, f) for o, f, a, b in sorted(every) if not said(by[a], by[b]) and not said(by[b], by[a])]
    got = [(r["a"], r["b"], r["family"]) for r in replication_candidates(df, top=25, parity=parity).collect()]
    assert got == want[:25]
    assert sorted((r["a"], r["b"], r["family"]) for r in replication_candidates(df, top=None, parity=parity).collect()) == sorted(want)


def test_pairs_of_two_blocks_are_not_made_in_one_loop(spark):
    """The two steps that make rows of arrays are in generated code of their own, so a row of the first is done before the next one's pairs are made."""
    from quillspark.operators import relations

    df = relations.pairs_within(spark.range(60).selectExpr("id % 2 as g", "id as v"), "g", "v")
    assert len(df.collect()) == 2 * 30 * 29 // 2
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    stages = dict(reversed(m) for m in re.findall(r"\*\((\d+)\) Generate explode\(ids_([ab])", plan))
    assert len(stages) == 2 and stages["a"] != stages["b"]
