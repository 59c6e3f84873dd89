"""Tokenisers and record files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
EDGE = ["", " ", "  ", "   a   b  ", "▁", "▁▁a", " a", "a ", "a" * 900, " " * 2500, "x" * 2501, "</s><s><unk>", "<0x0A>", "a<|endoftext|>B", "don't I'LL", "ǰ J̌ é É", "\x1c\x85\xa0"]


def texts(n=600, seed=1):
    rng = random.Random(seed)
    letters = " ab\n\t▁éßñ漢字🙂thein​0123\x00'.,"
    return EDGE + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_pieces_equal_library():
    import sentencepiece

    from quillspark.llm.sentencepiece_codec import Codec

    lib, own, t = sentencepiece.SentencePieceProcessor(model_file=PIECES), Codec(PIECES), texts()
    flat, at = own.encode(t, end=False)
    ids = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert ids == [lib.encode(x) for x in t]
    assert own.decode(flat, at) == [lib.decode(x) for x in ids]
    rng = random.Random(2)
    for _ in range(500):
        x = [rng.choice([rng.randint(0, 300), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 9))]
        assert own.decode(np.array(x, np.int64), np.array([0, len(x)])) == [lib.decode(x)]


def test_encode_decode_of_rows(spark):
    from quillspark.llm.sentencepiece_codec import encode_decode

    df = spark.createDataFrame([(1, None, 5), (1, "ab", 5), (None, "ab", 6), (2, "", 7)], "doc_id long, text string, ids long")
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in encode_decode(df, PIECES).collect()), key=repr)
    assert [x for x in got if x[0] == 2] == [(2, [2], "")]
    assert (1, [2], "") in got and len(got) == 4
    assert encode_decode(df.limit(0), PIECES).count() == 0


def test_counts_equal_library():
    from tokenizers import Tokenizer, models, normalizers

    from quillspark.llm.token_counts import Counter, vocabulary

    v = vocabulary(PIECES)
    lib = Tokenizer(models.Unigram(v, 0, True))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    c = Counter(v)
    t = [*texts(300, 3), "\u0600\u0601" * 20_000 + "the", "thing" * 4000, "é漢a" * 3000]
    assert c.count(t)[0].tolist() == [len(lib.encode(x, add_special_tokens=False).ids) for x in t]


def test_counts_of_texts_that_hold_special_pieces():
    """The unknown piece's text is a piece alone and part of a run beside others; control pieces are pieces."""
    import random

    from tokenizers import Tokenizer, models, normalizers

    from quillspark.llm.token_counts import Counter, vocabulary

    v = vocabulary(PIECES)
    lib = Tokenizer(models.Unigram(v, 0, True))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rng = random.Random(6)
    parts = ["<unk>", "<s>", "</s>", "a", "the ", " ", "é", "<0x0A>", "unk", "<", ">", "\U0001f600", "日本", "\x01\x02"]
    texts = ["<unk>", "x<unk>y", "<unk><unk>", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(2000))]
    n, _ = Counter(v).count(texts)
    assert n.tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_rows(spark):
    from quillspark.llm.token_counts import count_tokens

    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "a b", 0)], "doc_id long, text string, score long")
    assert sorted((r["doc_id"], r["n_tokens"] > 0) for r in count_tokens(df, PIECES).collect()) == [(1, False), (2, False), (2, True)]


def test_words_equal_library():
    from tokenizers import Tokenizer

    from quillspark.llm.record_files import ChunkEncoder

    lib, own, t = Tokenizer.from_file(WORDS), ChunkEncoder(WORDS), texts(600, 4)
    flat, at = own.encode(t, 1)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids + [1] for e in lib.encode_batch(t, add_special_tokens=False)]


def test_record_files(spark, tmp_path):
    from tokenizers import Tokenizer

    from quillspark.llm.record_files import checksums, frame, pack, read_token_files, unframe, unpack, write_token_files

    rows = [(5, "b c"), (1, "a"), (3, None), (3, "zz"), (None, "n"), (3, "zz")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    manifest = write_token_files(df, WORDS, str(tmp_path / "rec"))
    got = sorted(((r["start"], r["id"], r["n_tokens"], r["ids_crc32"]) for r in checksums(read_token_files(spark, manifest)).collect()))
    assert [g[1] for g in got] == [None, 1, 3, 3, 3, 5]
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    lib = Tokenizer.from_file(WORDS)
    assert got[-1][3] == zlib.crc32(np.array([*lib.encode("b c", add_special_tokens=False).ids, 1], "<u4").tobytes())
    data = frame(pack(np.arange(9), 2))
    assert unpack(unframe(memoryview(data), 0)[0]).tolist() == list(range(9))
    with pytest.raises(ValueError):
        unframe(memoryview(data[:13] + b"\xff" + data[14:]), 0)
    empty = write_token_files(df.limit(0), WORDS, str(tmp_path / "none"))
    assert read_token_files(spark, empty).count() == 0


def test_digests(spark, tmp_path):
    import sentencepiece

    from quillspark.llm.queries import op1_sentencepiece

    spark.createDataFrame([(1, "Ein Text."), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [*lib.encode("Ein Text."), 2]
    r = op1_sentencepiece(spark, str(tmp_path)).where("doc_id = 1").first()
    assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert r["decoded_sha256"] == hashlib.sha256(b"Ein Text.").hexdigest()


def test_long_words_equal_library():
    import random

    import sentencepiece

    from quillspark.llm.sentencepiece_codec import Codec

    rng = random.Random(1)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), Codec(PIECES)
    t = ["".join(rng.choice(a) for _ in range(n)) for a, n in (("abcdefghié", 2001), ("the and ing▁".replace(" ", ""), 30_000), ("ab", 5000), ("漢é🙂a", 3000), ("abcdefghijklmnopqrstuvwxyz0123456789+/", 1_000_000))]
    t += ["a" * 20_001, " " * 30_001, *(" " * n + "the x" + " " * n for n in range(14, 70)), "\n" * 500 + " " * 47 + "\n"]
    flat, at = own.encode(t, end=False)
    for k, x in enumerate(t):
        assert flat[at[k] : at[k + 1]].tolist() == lib.encode(x), x[:80]
    assert own.decode(flat, at) == [lib.decode(lib.encode(x)) for x in t]


def test_many_record_files_keep_the_order(spark, tmp_path, monkeypatch):
    """Hot, null and extreme ids over many files: a total order, every row once."""
    from quillspark.llm import record_files as r

    monkeypatch.setattr(r, "FILE_TEXT", 500)
    rng = random.Random(4)
    ids = [None, -(2**63), 2**63 - 1, *[7] * 300, *(rng.randint(-5, 20) for _ in range(300)), None]
    rows = [(i, rng.choice(["same text", "x" * rng.randint(1, 40), "a b c", None, ""])) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = r.write_token_files(df, WORDS, str(tmp_path / "rec"))
    shards = sorted(manifest.collect())
    assert len(shards) > 8 and max(x["n_docs"] for x in shards) < 200
    got = sorted(r.read_token_files(spark, manifest).collect(), key=lambda x: x["start"])
    keys = [(x["id"] is not None, x["id"] or 0) for x in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    want = sorted(repr((i, [*lib.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    assert sorted(repr((x["id"], x["ids"])) for x in got) == want
    assert [x["start"] for x in got] == [sum(len(y["ids"]) for y in got[:k]) for k in range(len(got))]
