"""Window removal, near duplicates and decontamination against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa

LETTERS = "abcdefgh"


def sentence(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 6))) for _ in range(n))


def brute_spans(texts, width):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def windows_fixture():
    rng = random.Random(5)
    a = sentence(rng, 120)
    return [None, "", "short", a, a, a[100:400] + sentence(rng, 30), sentence(rng, 20) + a[50:300] + sentence(rng, 20), "ab " * 150, sentence(rng, 100), "é" * 200, sentence(rng, 10) + a[120:321]]


def test_windows_equal_brute_force(spark, monkeypatch):
    from quillspark.llm import window_dedup as w

    texts = windows_fixture()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans long")
    want = brute_spans(texts, 200)
    monkeypatch.setattr(w, "DIGIT", 80)  # fewer levels
    for crowd in (20_000, 1):
        monkeypatch.setattr(w, "CROWD", crowd)
        cut = w.repeated_windows(df)
        rows = df.select("doc_id", "text", *w.text_key("text")).join(cut, ["k0", "k1"], "left").collect()
        assert all((bytes(r["kept"]) if r["kept"] is not None else (r["text"] or "").encode()) == want[r["doc_id"]] for r in rows)
    assert w.repeated_windows(df.limit(0)).count() == 0


def test_next_digits_deal_out_every_window():
    """Whatever a run's windows, each goes to one group at every level, until all its bytes are in the key."""
    from quillspark.llm.window_dedup import next_digits

    width, free = 200, 168
    raw = bytes(range(256)) * 2
    for at, windows in ((168, 169), (0, 1), (90, 40), (168, 1), (30, 31), (100, 3)):
        state = [(b"", 0, 0, 0, free)]
        want = set(range(at - windows + 1, at + 1)) & set(range(free + 1))
        done = set()
        for _ in range(60):
            new = []
            for key, left, right, low, high in state:
                if low == high and left == low and right == free - low:
                    done.add(low)
                    continue
                for digit, *s in next_digits(raw, at, windows, left, right, low, high, width):
                    assert s[0] <= s[2] <= s[3] <= free - s[1] and (s[0], s[1]) != (left, right) and len(digit) > 1
                    new.append((key + digit, *s))
            state = new
            covered = [j for _, _, _, low, high in state for j in range(low, high + 1) if j in want]
            assert len(covered) == len(set(covered)) and set(covered) | done == want
            if not state:
                break
        assert done == want and not state


def test_windows_of_one_anchor_in_many_runs(spark, monkeypatch):
    """Hundreds of different runs around one anchor, with repeats that begin in front of it, behind it, and far from it."""
    from quillspark.llm import window_dedup as w

    rng = random.Random(8)
    some = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    hub = some(60)
    sides = [(some(160), some(160)) for _ in range(12)]
    texts = []
    for _ in range(150):
        (left, _), (_, right) = rng.choice(sides), rng.choice(sides)
        texts.append(some(40) + left[rng.randrange(100) :] + hub + right[: rng.randrange(60, 160)] + some(40))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute_spans(texts, 200)
    for crowd, digit in ((20, 8), (1, 60)):
        monkeypatch.setattr(w, "CROWD", crowd)
        monkeypatch.setattr(w, "DIGIT", digit)
        rows = df.select("doc_id", "text", *w.text_key("text")).join(w.repeated_windows(df), ["k0", "k1"], "left").collect()
        got = {r["doc_id"]: bytes(r["kept"]) if r["kept"] is not None else r["text"].encode() for r in rows}
        assert got == dict(enumerate(want)), crowd
    assert sum(len(x) < len(t) for x, t in zip(want, texts, strict=True)) > 30


def test_radix_groups():
    from quillspark.llm.window_dedup import radix_groups

    flat = np.frombuffer(b"abcdefghijXabcdefghijYabcdefghiZ" + b" " * 8, np.uint8)
    starts = np.array([0, 11, 22, 1])
    assert radix_groups(flat, starts, np.zeros(4, np.int64), 10).tolist() == [True, True, False, False]
    assert radix_groups(flat, starts, np.array([0, 1, 1, 1]), 9).tolist() == [False, True, True, False]


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_equals_brute_force(spark):
    from quillspark.llm.jaccard_join import near_duplicates

    rng = random.Random(7)
    rows, base = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "One"), (5, "one two")], [sentence(rng, rng.randint(20, 90)) for _ in range(4)]
    for i in range(6, 90):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w[k] = rng.choice([w[k].upper(), sentence(rng, 1), ""])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, size long")
    for n, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, n=n, percent=percent).collect()}
        assert got == brute_components(rows, n, percent)
    odd = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None)], "doc_id long, text string")
    assert sorted(map(repr, (tuple(r) for r in near_duplicates(odd).collect()))) == sorted(map(repr, [(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2)]))
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    from quillspark.llm._common import connected_components

    edges = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 105: 100, 101: 100}


def test_best_place_is_edit_distance():
    from quillspark.llm.decontamination import best_place

    def brute(a, s):
        row = [0] * (len(s) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(s):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    rng = random.Random(3)
    for _ in range(300):
        a, s = [rng.randrange(4) for _ in range(rng.randint(1, 8))], [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        d, i, j = best_place(np.array(a), np.array(s, dtype=np.int64))
        assert d == brute(a, s) and 0 <= i <= j <= len(s)


def test_leaks_are_found_and_clean_texts_stay(spark):
    from quillspark.llm.decontamination import Index, drop_leaks, find_leaks

    rng = random.Random(11)
    items = [sentence(rng, rng.randint(12, 60)) for _ in range(60)]
    planted = []
    for t in items:
        w = t.split()
        for _ in range(int(len(w) * 0.2)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([["zzz"], [], [w[k], "yyy"]])
        planted.append(f"{sentence(rng, 20)} {' '.join(w)} {sentence(rng, 20)}")
    ix = Index(list(range(60)), items)
    flat, at = pa.array(planted).buffers()[2], np.r_[0, np.cumsum([len(p.encode()) for p in planted])]
    found = {(t, k) for t, k, *_ in ix.search(np.frombuffer(flat, np.uint8)[: at[-1]], at)}
    assert sum((k, k) in found for k in range(60)) >= 0.9 * 60
    docs = spark.createDataFrame([(0, None, 1), (1, "", 1), (2, f"x {items[0].upper()}, y", 1), (2, sentence(rng, 80), 1)], "doc_id long, text string, edits long")
    bench = spark.createDataFrame([(0, items[0]), (1, None), (2, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["edits"], r["start"]) for r in find_leaks(docs, bench).collect()] == [(2, 0, 0, 1)]
    assert drop_leaks(docs, bench).count() == 3 and drop_leaks(docs, bench.limit(0)).count() == 4


def edited_copies(rng, items, times):
    """(item, text): copies with as many random edits as are allowed."""
    out = []
    for k, t in enumerate(items):
        for _ in range(times):
            w = t.split()
            for _ in range(int(len(w) * 0.2)):
                j = rng.randrange(len(w))
                w[j : j + 1] = rng.choice([["zzz"], [], [w[j], "yyy"]])
            out.append((k, " ".join(w)))
    return out


def searched(ix, texts):
    raw = [t.encode() for t in texts]
    return {(t, k) for t, k, *_ in ix.search(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])}


def test_leaks_of_every_length_are_found():
    from quillspark.llm.decontamination import Index, best_place

    rng = random.Random(23)
    items = [sentence(rng, n) for n in range(8, 60) for _ in range(4)]
    ix = Index(list(range(len(items))), items)
    copies = edited_copies(rng, items, 25)
    got = searched(ix, [f"{sentence(rng, 20)} {c} {sentence(rng, 20)}" for _, c in copies])
    reached = collections.defaultdict(list)
    for i, (k, c) in enumerate(copies):
        a, b = items[k].split(), c.split()
        code = {x: j for j, x in enumerate(dict.fromkeys(a + b))}
        assert best_place(np.array([code[x] for x in a]), np.array([code[x] for x in b]))[0] <= int(len(a) * 0.2)
        reached[len(a)].append((i, k) in got)
    low = {n: sum(v) / len(v) for n, v in reached.items() if sum(v) / len(v) < 0.92}
    assert not low
    assert min(ix.recall.values()) >= 0.95


def test_leak_shorter_than_its_window_is_found():
    from quillspark.llm.decontamination import Index

    item = [f"word{i}" for i in range(16)]
    ix = Index([0], [" ".join(item)])
    cut = [" ".join(x for j, x in enumerate(item) if j not in gone) for gone in ((0, 1, 2), (13, 14, 15), (0, 7, 15), (3, 8, 12))]
    assert searched(ix, cut) == {(t, 0) for t in range(4)}


def test_edits_that_stand_together_are_found():
    from quillspark.llm.decontamination import Index, unknown_words

    assert [unknown_words(n, n // 5, 16) for n in (16, 20, 24, 25, 27, 28, 31, 32, 40, 48)] == [3, 4, 4, 5, 5, 4, 3, 3, 4, 3]
    rng = random.Random(31)
    for n in (25, 26, 27):
        items = [" ".join(f"w{n}x{k}x{j}" for j in range(n)) for k in range(40)]
        ix = Index(list(range(40)), items)
        texts = []
        for t in items:
            w = t.split()
            w[11:16] = [f"foreign{j}" for j in range(5)]
            texts.append(f"{sentence(rng, 20)} {' '.join(w)} {sentence(rng, 20)}")
        found = searched(ix, texts)
        assert sum((k, k) in found for k in range(40)) >= 30, n
