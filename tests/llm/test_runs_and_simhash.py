"""Periodic runs and SimHash components against brute force, on fixtures and on the whole small tables."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=24, periods=3):
    """(start, length, period) by comparing words at every distance."""
    out = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def rows_of(df):
    return {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]) for r in df.collect()}


def test_runs_of_random_words():
    from quillspark.llm.periodic_runs import maximal_runs

    rng = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(0, 10)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 70))]
            if w and rng.random() < 0.6:
                a, p = rng.randrange(len(w)), rng.randint(1, 7)
                w = [w[min(a + (i - a) % p, len(w) - 1)] if i >= a else x for i, x in enumerate(w)]
            texts.append(w)
        least, periods = rng.choice([(24, 3), (6, 3), (4, 2), (2, 2)])
        found = maximal_runs(np.array(sum(texts, []), np.int64), np.array([len(w) for w in texts], np.int64), least, periods)
        got = [[] for _ in texts]
        for t, *r in zip(*(x.tolist() for x in found), strict=True):
            got[t].append(tuple(r))
        assert got == [sorted(brute_runs(w, least, periods), key=lambda r: (r[0], r[2])) for w in texts]


def test_runs_of_odd_rows(spark):
    from quillspark.llm.periodic_runs import find_runs

    prose = " ".join(f"w{i * i % 97}" for i in range(60))
    texts = [None, "", " \t\n ", "one", "a " * 24, "a " * 23, "x y " * 12, "x\ty\n" * 11, "é ü " * 13 + "é", prose, ("p q " * 20 + "r ") * 4, "A a " * 12, "  " * 30, "a " * 30 + "b " * 30]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, n_words int")
    got = rows_of(find_runs(df))
    for i, t in enumerate(texts):
        w = words(t)
        assert got[i] == (brute_runs(w), collapsed(w, brute_runs(w)), len(w)), i
    assert got[4][0] == [(0, 24, 1)] and got[4][1] == "a" and not got[5][0] and got[6][0] == [(0, 24, 2)]
    assert find_runs(df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a " * 30), (None, "a " * 30), (1, "b"), (1, "a " * 24)], "doc_id long, text string")
    assert sorted(len(r["runs"]) for r in find_runs(same).collect()) == [0, 1, 1, 1]
    with pytest.raises(ValueError):
        from quillspark.llm.periodic_runs import maximal_runs

        maximal_runs(np.zeros(3, np.int64), np.array([3]), 2, 1)


def test_runs_of_very_long_texts(spark):
    from quillspark.llm.periodic_runs import find_runs

    rng = random.Random(2)
    part = [rng.choice("abcdefgh") for _ in range(50_000)]
    prose = [f"w{rng.randrange(2000)}" for _ in range(100_000)]
    texts = ["a " * 400_000, " ".join(part * 4), " ".join(prose) + " x y z" * 9, "longword" * 100_000]
    got = rows_of(find_runs(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")))
    assert got[0] == ([(0, 400_000, 1)], "a", 400_000)
    assert (0, 200_000, 50_000) in got[1][0]
    assert got[2][0] == [(100_000, 27, 3)] and got[2][1] == " ".join(prose) + " x y z"
    assert got[3] == ([], texts[3], 1)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]


def run_row(doc_id, text):
    w = planted(doc_id, words(text))
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))


@tables
def test_runs_of_the_whole_table(spark):
    from quillspark.llm.queries import op11_runs

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_runs(spark, SMALL).collect()}
    assert got == {d: run_row(d, t) for d, t in texts.items()}
    assert sum(r[0] > 0 for r in got.values()) > 5


def test_planting_of_odd_rows(spark):
    from quillspark.llm.queries import _with_planted_runs

    texts = [None, "", "  ", "one", "a b", "a b c d e f g h i j " * 5, "x\ty\nz"]
    df = spark.createDataFrame([(i, texts[i % 7], 1) for i in range(300)] + [(None, "a b", 1)], "doc_id long, text string, _n int")
    for r in _with_planted_runs(df).collect():
        t = "a b" if r["doc_id"] is None else texts[r["doc_id"] % 7]
        assert words(r["text"]) == (words(t) if r["doc_id"] is None else planted(r["doc_id"], words(t)))


def fingerprint(text, n=3):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    grams = [" ".join(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=2):
    """The smallest id that each of ``fps(id, number)`` reaches, by comparing all pairs."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(fps):
        for j, y in fps[:k]:
            if (x ^ y).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in fps}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_masks_cover_every_pair(radius):
    from itertools import combinations

    from quillspark.llm.simhash_join import covering_masks

    for free in ((1 << 64) - 1, 0xFF00FF0F, 0b1011, 1, 0):
        masks = covering_masks(free, radius)
        places = [k for k in range(64) if free >> k & 1][:: 1 if radius < 3 else 3]
        assert len(masks) == 2 ** (radius + 1) - 1 and all(m & ~free == 0 for m in masks)
        for at in combinations(places, min(radius, len(places))):
            assert any(not any(m >> k & 1 for k in at) for m in masks)


def test_levels_leave_small_buckets():
    from quillspark.llm.simhash_join import BUCKET, covering_masks

    free = [(1 << 64) - 1]
    for _ in range(3):
        free = [f & ~m for f in free for m in covering_masks(f, 2)]
    assert max(2 ** f.bit_count() for f in free) <= BUCKET


@pytest.mark.parametrize("bucket", [256, 64])
def test_near_fingerprints(spark, monkeypatch, bucket):
    """A crowd around one fingerprint, chains, both ends of the signed range, whatever the size of a bucket."""
    from quillspark.llm import simhash_join as s

    monkeypatch.setattr(s, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = {0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1}
    for center in [rng.getrandbits(64) for _ in range(6)]:
        at = center
        for _ in range(150):
            fps.add(at := at ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ rng.choice([0, 1 << rng.randrange(64)]))
            at = rng.choice([at, center])
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 3))) for _ in range(2000)}
    fps = sorted(fps)
    want = components(list(enumerate(fps)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    parts = s.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"))
    at = {x: i for i, x in enumerate(signed)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for part in parts:
        for a, b in part.collect():
            x, y = sorted((find(at[a]), find(at[b])))
            root[y] = x
    assert {i: find(i) for i in range(len(fps))} == want
    assert bucket == 256 or len(parts) > 1


def test_simhash_of_odd_rows(spark):
    from quillspark.llm.simhash_join import near_simhashes

    long = " ".join(f"w{i * 7919 % 5000}" for i in range(150_000))
    texts = [None, "", " \n", "one", "ONE", "one two", "one  two\n", "É é ABC", "é é abc", "a b c d", "a b c d " * 500, long, long.replace("w7919 ", "other "), "x" * 300_000, " "]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string, fp int")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_simhashes(df).collect()}
    fps = [(i, fingerprint(t)) for i, t in enumerate(texts)]
    want = components(fps)
    assert got == {i: (f"{x:016x}", want[i]) for i, x in fps}
    assert got[2] == ("0" * 16, 0) and got[12][1] == 11
    assert near_simhashes(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "q r s"), (None, "z z z z"), (3, "A B")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in near_simhashes(odd).collect())
    assert rows == [(-1, -1), (-1, 3), (3, 3), (7, 3), (7, 7)]
    with pytest.raises(ValueError):
        near_simhashes(odd, radius=6)


@tables
def test_simhash_of_the_whole_table(spark):
    from quillspark.llm.queries import op12_simhash

    rows = [(r["doc_id"], fingerprint(r["text"])) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = components(sorted(rows))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op12_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{x:016x}", want[i]) for i, x in rows}
    assert len(set(want.values())) < len(want)
