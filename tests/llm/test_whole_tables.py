"""Queries and pipeline stages over the whole small tables, against libraries and brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

SMALL = "/root/testdata/sf0.001"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def components(sets, percent):
    """Component of each id by comparing all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def leaks(docs, items):
    """(doc, item) pairs within the edits that are allowed, by the edit distance of each item to every stretch of each text."""
    from quillspark.llm.decontamination import EDITS, best_place

    code = {}
    of = lambda t: np.array([code.setdefault(w, len(code)) for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))], np.int64)
    texts = {i: of(t) for i, t in docs.items()}
    wanted = {i: of(t) for i, t in items.items()}
    return {(d, i) for d, t in texts.items() for i, x in wanted.items() if len(t) and len(x) and best_place(x, t)[0] <= int(len(x) * EDITS)}


def test_pieces(spark, docs):
    import sentencepiece

    from quillspark.llm.queries import op1_sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op1_sentencepiece(spark, SMALL).collect()}
    assert set(got) == set(docs)
    for d, t in docs.items():
        ids = [*lib.encode(t), 2]
        assert got[d] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))), d


def test_windows(spark, docs):
    from quillspark.llm.queries import op5_windows

    raw = {d: t.encode() for d, t in docs.items()}
    count = Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    for r in op5_windows(spark, SMALL).collect():
        b = raw[r["doc_id"]]
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        runs = int((np.diff(np.r_[False, gone[:-1], False].astype(int)) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), runs, sha(kept)), r["doc_id"]


def test_windows_of_long_texts_and_blocks(spark, monkeypatch):
    """Texts cut into pieces give what whole ones give."""
    import random

    from quillspark.llm import window_dedup as w

    rng = random.Random(3)
    part = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) + part + "x" * 700, part[100:800] + "".join(rng.choice("abcd") for _ in range(2000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = sorted(map(repr, (r.asDict() for r in w.repeated_windows(df).collect())))
    monkeypatch.setattr(w, "PIECE", 450)
    assert sorted(map(repr, (r.asDict() for r in w.repeated_windows(df).collect()))) == whole and len(whole) == 2


def test_counts(spark, docs):
    from tokenizers import Tokenizer, models, normalizers

    from quillspark.llm.queries import op7_token_counts
    from quillspark.llm.token_counts import vocabulary

    lib = Tokenizer(models.Unigram(vocabulary(PIECES), 0, True))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = {r["doc_id"]: r["n_tokens"] for r in op7_token_counts(spark, SMALL).collect()}
    assert got == {d: len(lib.encode(t, add_special_tokens=False).ids) for d, t in docs.items()}


def test_records(spark, docs):
    from tokenizers import Tokenizer

    from quillspark.llm.queries import op8_records

    lib, start = Tokenizer.from_file(WORDS), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op8_records(spark, SMALL).collect()}
    for d in sorted(docs):
        ids = [*lib.encode(docs[d], add_special_tokens=False).ids, 1]
        assert got.pop(d) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), d
        start += len(ids)
    assert not got


def test_similar_sets(spark, docs, monkeypatch):
    from quillspark.llm import jaccard_join as j
    from quillspark.llm.queries import op10_jaccard

    sets = {d: shingles(t, 4) for d, t in docs.items()}
    want = components(sets, 85)
    for block in (2000, 2):  # small blocks split every token's sets
        monkeypatch.setattr(j, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_jaccard(spark, SMALL).collect()}
        assert got == {d: (len(sets[d]), want[d]) for d in docs}


def test_leaks(spark, docs):
    from quillspark.llm.queries import op3_decontamination

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op3_decontamination(spark, SMALL).collect()}
    want = leaks(docs, items)
    assert got <= want and len(got) >= 0.95 * len(want)


def test_every_stage_of_the_pipeline(spark, docs):
    """Each stage's rows against brute force on what the stage before kept."""
    import duckdb
    import sentencepiece

    import corpus_pipeline as c
    from quillspark.llm.queries import OP2_SQL

    stage = dict(c.STAGES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    now = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = lambda df: {r["doc_id"]: r["text"] or "" for r in df.collect()}

    now = c.stored(stage["quality rules"](spark, now, SMALL), "q")
    passed = texts(now)
    assert set(passed) == {r[0] for r in con.execute(f"SELECT doc_id FROM ({OP2_SQL}) WHERE kept").fetchall()}
    now = c.stored(stage["n-gram Jaccard join"](spark, now, SMALL), "j")
    one = texts(now)
    group = components({d: shingles(t, 5) for d, t in passed.items()}, 80)
    assert sorted(group[d] for d in one) == sorted(set(group.values()))
    now = c.stored(stage["benchmark decontamination"](spark, now, SMALL), "d")
    clean = texts(now)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    found = {d for d, _ in leaks(one, items)}
    assert set(one) - set(clean) <= found and len(set(one) - set(clean)) >= 0.95 * len(found)
    now = c.stored(stage["secret scans"](spark, now, SMALL), "s")
    safe = {r["doc_id"]: (r["text"], r["n_chars"]) for r in now.collect()}
    assert {d: t for d, (t, _) in safe.items()} == {d: re.sub(r'(token = ")[0-9a-f]{40}(?=")', r"\1[REDACTED]", t) for d, t in clean.items()}
    assert all(n == len(t) for t, n in safe.values())
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = {r["doc_id"]: r for r in stage["SentencePiece encoding and decoding"](spark, now, SMALL).collect()}
    assert set(out) == set(safe)
    for d, (t, _) in safe.items():
        ids = [*lib.encode(t), 2]
        assert out[d]["ids"] == ids and out[d]["decoded_sha256"] == sha(lib.decode(ids))


def test_pipeline_of_odd_tables(spark):
    """Empty tables, null columns, and columns named like the stages' own."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (_, f) in enumerate(c.STAGES):
        assert f(spark, docs.limit(0), SMALL).count() == 0, k
    odd = spark.createDataFrame([(None, None, None, None, None, "x", "y", 1)] * 3, docs.schema.add("_q_text", "string").add("_s_parts", "string").add("_row", "long"))
    for _, f in c.STAGES[:4]:
        out = f(spark, odd, SMALL)
        assert out.columns == odd.columns and out.count() in (0, 3)


def test_one_very_long_text(spark):
    """A text of two million letters goes through every operator that works row by row."""
    import sentencepiece

    from quillspark.llm.decontamination import find_leaks
    from quillspark.llm.license_scan import scan_licenses
    from quillspark.llm.quality_rules import quality_report
    from quillspark.llm.sentencepiece_codec import encode_decode

    words = [f"w{k % 5000}x" for k in range(300_000)]
    item = " ".join(f"leaked{k}" for k in range(30))
    text = " ".join([*words, "under the MIT license", item, "z" * 300_000])
    df = spark.createDataFrame([(1, text, "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    n = len(words) + 4 + 30 + 1
    got = {r["doc_id"]: r for r in quality_report(df).collect()}
    assert got[1]["n_words"] == n and got[1]["n_repeat_words"] == 300_000 and got[2]["n_words"] == 0
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    assert got[1]["n_words"] == n and got[1]["first_word"] == 300_000 and got[1]["base_labels"] == "mit" and got[2]["n_words"] == 0
    [leak] = find_leaks(df, spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")).collect()
    assert (leak["doc_id"], leak["item_id"], leak["edits"], leak["start"], leak["end"]) == (1, 7, 0, 300_004, 300_034)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in encode_decode(df, PIECES).collect()}
    assert got[1]["ids"] == [*lib.encode(text), 2] and got[1]["decoded"] == text and got[2]["ids"] == [2]


def test_ties_of_leaks(spark):
    """Repeated rows and items each give their rows; of equal places the first is named."""
    from quillspark.llm.decontamination import drop_leaks, find_leaks

    item = " ".join(f"leaked{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"a {item} b {item} c")] * 2 + [(None, item), (3, None), (4, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["start"]) for r in find_leaks(docs, items).collect()))
    assert got == sorted([(1, 7, 1), (1, 7, 1), (1, 8, 1)] * 2 + [(0, 7, 0), (0, 7, 0), (0, 8, 0)])
    assert sorted(r["doc_id"] for r in drop_leaks(docs, items).collect()) == [3, 4]
