"""Token ids in length-delimited binary record files with a separate offset index.

A data file is a row of records, each ``u64 length, u32 masked crc of the length
field, payload, u32 masked crc of the payload`` (little-endian). The checksum is
CRC-32, masked as in the usual record framing: rotated right by 15 bits plus a
constant. A payload is one byte, the width of an id (2 or 4), and the ids. The
index file beside it has one fixed-size entry a record: ``u64 offset, i64 id,
u8 id is null, u32 number of ids``; a reader seeks to any record by it.
"""

from __future__ import annotations

import bisect
import functools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import CodeBook, checkpointed, flat_text, ranges, steps, tidy

MASK_DELTA = 0xA282EAD8
INDEX_ENTRY = np.dtype([("offset", "<u8"), ("id", "<i8"), ("null", "u1"), ("n", "<u4")])
#: Bytes of text whose ids make one file, and the most files.
FILE_TEXT = 16 << 20
MOST_FILES = 50_000
#: Bytes of text that one step encodes.
STEP_TEXT = 1 << 21

#: Marks before which a letter's chunk ends.
MARKS = np.isin(np.arange(256), list(b".,;:!?*#$%&|"))
LETTERS = np.isin(np.arange(256), np.arange(97, 123))
SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
LOWERED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)

MANIFEST = "shard int, data string, index string, n_docs long, n_tokens long"


def masked(data: bytes) -> int:
    """Masked CRC-32."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(data: memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the record at an offset and the offset behind it; ValueError if a checksum differs."""
    head = bytes(data[at : at + 8])
    (length,), (crc,) = struct.unpack("<Q", head), struct.unpack("<I", data[at + 8 : at + 12])
    if crc != masked(head):
        raise ValueError(f"the length at offset {at} is damaged")
    payload = bytes(data[at + 12 : at + 12 + length])
    if len(payload) != length or struct.unpack("<I", data[at + 12 + length : at + 16 + length])[0] != masked(payload):
        raise ValueError(f"the record at offset {at} is damaged")
    return payload, at + 16 + length


def pack(ids: np.ndarray, width: int) -> bytes:
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


class ChunkEncoder:
    """Ids of the tokenizers library, with a memory of chunks between ASCII white space.

    Chunks are encoded on their own only where the tokenizer drops white space
    before it splits texts, so that no token and no normalisation crosses it; any
    other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_chunk = self._drops_space(spec)
        self.separator = next(((t["content"], t["id"]) for t in spec["added_tokens"] if t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"]), None)
        self.marks = [t["content"].encode() for t in spec["added_tokens"]]
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        vocab = self.tok.get_vocab(with_added_tokens=True)
        suffix = spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(vocab.values()) + 1, bool) if suffix else None
        for token, i in vocab.items() if suffix else ():
            self.last[i] = token.endswith(suffix)
        self.lower = self.by_chunk and "Lowercase" in json.dumps(spec["normalizer"]) and suffix is not None
        self.book = CodeBook()

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        import regex

        norm = spec.get("normalizer") or {}
        kinds = [n["type"] for n in norm.get("normalizers", [norm] if norm else [])]
        pre = spec.get("pre_tokenizer") or {}
        first = pre.get("pretokenizers", [pre])[0]
        if not set(kinds) <= {"NFC", "Lowercase", "Replace"} or spec.get("post_processor") or first.get("type") != "Split" or first["behavior"] != "Removed" or not first["invert"]:
            return False
        if any(n["type"] == "Replace" and (n["pattern"], n["content"]) != ({"Regex": "\\s+"}, " ") for n in norm.get("normalizers", [norm])):
            return False
        pattern = regex.compile(first["pattern"]["Regex"])
        return not any(s in m for s in " \t\n\r\x0b\x0c" for t in (f"a{s}b", f"1{s}2", f"!{s}?", f"'{s}s", s * 3) for m in pattern.findall(t))

    def _single(self, chunk: str) -> bool:
        """Whether the tokenizer's splitter surely leaves the chunk whole: letters alone, or ASCII marks alone."""
        return chunk.isalpha() or (chunk.isascii() and "'" not in chunk and not any(c.isalnum() or c <= " " or c == "\x7f" for c in chunk))

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk, and how many. Single words are told apart by their last token's end mark, others by a separator token."""
        words = [c.decode() for c in chunks]
        plain = np.array([self.last is not None and self._single(w) for w in words], bool)
        flat, sizes = np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        easy = np.flatnonzero(plain)
        for a in range(0, len(easy), 4000):
            part = easy[a : a + 4000]
            ids = np.array(self.tok.encode_batch_fast([" ".join([words[k] for k in part])], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(part) or (len(ids) and ends[-1] != len(ids) - 1):
                plain[part] = False  # the splitter knows these characters otherwise
                continue
            sizes[part] = np.diff(np.r_[-1, ends])
            out.append((part, ids))
        hard = np.flatnonzero(~plain)
        for a in range(0, len(hard), 4000):
            part = hard[a : a + 4000]
            marked = [k for k in part.tolist() if any(m in chunks[k] for m in self.marks)]
            text = self.separator[0].join([words[k] if not any(m in chunks[k] for m in self.marks) else "" for k in part.tolist()])
            ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)
            cuts = np.flatnonzero(ids == self.separator[1])
            sizes[part] = np.diff(np.r_[-1, cuts, len(ids)]) - 1
            pieces = np.split(np.delete(ids, cuts), np.cumsum(sizes[part])[:-1])
            for k in marked:
                at = int(np.searchsorted(part, k))
                pieces[at] = np.array(self.tok.encode(words[k], add_special_tokens=False).ids, np.int32)
                sizes[k] = len(pieces[at])
            out.append((part, np.concatenate(pieces)))
        start = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        for part, ids in out:
            flat[ranges(start[part], sizes[part])] = ids
        return flat, sizes

    def chunks(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Parts that encode on their own, and how many each text has: split at ASCII white space and between a letter and a common mark, letters A-Z lowered.

        A lowered letter before a combining mark could compose otherwise, so texts
        with such marks, and texts with added tokens, are split at white space only.
        """
        text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        apart = np.full(len(offsets) - 1, self.lower)
        if self.lower:
            apart[text[np.flatnonzero((flat & 0xFE) == 0xCC)]] = False
            data = flat.tobytes()
            for m in self.marks:
                at = data.find(m)
                while at >= 0:
                    apart[text[at]] = False
                    at = data.find(m, at + 1)
        lone = apart[text]
        low = np.where(lone, LOWERED[flat], flat)
        inside = ~SPACES[flat]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (lone[1:] & LETTERS[low[:-1]] & MARKS[low[1:]])
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        new[edge] = inside[edge]
        start = np.flatnonzero(new)
        place = np.cumsum(inside, dtype=np.int32)
        at = np.r_[place[start] - 1, inside.sum()].astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(low[inside])])
        return found, np.diff(np.searchsorted(start, offsets))

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each with the end id last, and their n + 1 offsets; null counts as empty."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.by_chunk or self.separator is None:
            rows = [e.ids for e in self.tok.encode_batch(["" if t is None else t for t in texts.to_pylist()], add_special_tokens=False)]
            flat, ends = np.array([i for r in rows for i in r], np.int32), np.cumsum([len(r) for r in rows])
        else:
            found, counts = self.chunks(*flat_text(texts))
            flat, size = self.book.look_up(found, self._encode_chunks)
            ends = np.r_[0, np.cumsum(size)][np.cumsum(counts)]
        ends = np.asarray(ends, np.int64)
        if end_id is not None:
            flat = np.insert(flat, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
        return flat, np.r_[0, ends]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """The tokenizer of a file, loaded once in each worker."""
    return ChunkEncoder(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, out_uri: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """Writes the ids of all rows in ascending id order; returns the manifest of files.

    Texts are encoded where they are read, and packed ids are dealt by ranges of the id, with the text's hash and a row number to
    split ties, so that a repeated id doesn't fill one file; equal ids stand in the
    order of their hash. Null ids come first. Null and empty texts give a record of
    the end id alone. Other columns are not read; an empty table gives no file with
    records. A file belongs to one task attempt, and the manifest (checkpointed, so
    that files are written once) names those of the successful ones: lost executors
    leave stray files but no wrong result. ``out_uri`` must be reachable by all
    executors; ids must fit 64-bit integers.
    """
    run_id = uuid.uuid4().hex
    number = F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), number.alias("at"), F.col(text_col).alias("text"))
    bounds = file_bounds(rows)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)
    packed = "part int, id long, tie long, at long, n int, payload binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in tidy(batches, enc.book):
            part = file_of(shared.value, *batch.columns[:3])
            _, offsets = flat_text(batch.column(3))
            for a, b in steps(offsets, STEP_TEXT):
                flat, cut = enc.encode(batch.column(3).slice(a, b - a), end_id)
                payload = [pack(flat[x:y], enc.width) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                keys = [batch.column(k).slice(a, b - a) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(part[a:b]), *keys, pa.array(np.diff(cut).astype(np.int32)), pa.array(payload, pa.binary())], names=["part", "id", "tie", "at", "n", "payload"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = pafs.FileSystem.from_uri(out_uri)
        files.create_dir(base, recursive=True)
        name = f"{run_id}-{task.partitionId():06d}-{task.taskAttemptId()}"
        at = n_docs = n_tokens = 0
        with files.open_output_stream(f"{base}/{name}.rec") as data, files.open_output_stream(f"{base}/{name}.idx") as index:
            for batch in tidy(batches):
                entries = np.zeros(len(batch), INDEX_ENTRY)
                entries["id"] = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                entries["null"] = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                entries["n"] = batch.column(1).to_numpy()
                sizes = np.zeros(len(batch), np.int64)
                for k, payload in enumerate(batch.column(2)):
                    sizes[k] = data.write(frame(payload.as_buffer().to_pybytes()))
                entries["offset"] = at + np.cumsum(sizes) - sizes
                index.write(entries.tobytes())
                at, n_docs, n_tokens = at + int(sizes.sum()), n_docs + len(batch), n_tokens + int(entries["n"].sum(dtype=np.int64))
        row = {"shard": task.partitionId(), "data": f"{out_uri}/{name}.rec", "index": f"{out_uri}/{name}.idx", "n_docs": n_docs, "n_tokens": n_tokens}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("data", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # packed ids move, not texts: one shuffle of about two bytes a token
    dealt = rows.mapInArrow(encode, packed).repartitionById(len(bounds) + 1, "part").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "at")
    return checkpointed(dealt.select("id", "n", "payload").mapInArrow(write, MANIFEST))


def file_bounds(rows: DataFrame) -> list[tuple[bool, int, int, int]]:
    """The first keys (id is no null, id, tie, at) of all files but the first, from a sample of keys.

    Files hold about ``FILE_TEXT`` bytes of text each, more where that would make
    over ``MOST_FILES``. The sample only balances the files: any bounds give the
    same order. At most about a million keys reach the driver.
    """
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    files = min(MOST_FILES, size["n"], -(-size["b"] // FILE_TEXT))
    if files < 2:
        return []
    share = min(1.0, min(100 * files, 1_000_000) / size["n"])
    keys = rows.select("id", "tie", "at").sample(share, 1).toArrow()
    order = sorted((i is not None, i if i is not None else 0, t, a) for i, t, a in zip(*(c.to_pylist() for c in keys.columns), strict=True))
    return sorted({order[k * len(order) // files] for k in range(1, files)}) if order else []


def file_of(bounds: list[tuple[bool, int, int, int]], ids: pa.Array, ties: pa.Array, ats: pa.Array) -> np.ndarray:
    """The file of each row: how many bounds are not above its key."""
    if not bounds:
        return np.zeros(len(ids), np.int32)
    low = np.iinfo(np.int64).min
    edge = np.array([b[1] if b[0] else low for b in bounds], np.int64)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    own = np.where(null, low, ids.fill_null(0).to_numpy(zero_copy_only=False))
    out, last = np.searchsorted(edge, own, "left"), np.searchsorted(edge, own, "right")
    tie, at = ties.to_numpy(), ats.to_numpy()
    for k in np.flatnonzero(out < last).tolist():  # ids that are a bound's
        out[k] = bisect.bisect_right(bounds, (not null[k], 0 if null[k] else int(own[k]), int(tie[k]), int(at[k])))
    return out.astype(np.int32)


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(id long, start long, ids array<int>) of all records, read through the index, checksums verified.

    ``start`` counts the ids of all records before. One task reads one file; the
    driver sees a row a file.
    """
    shards = sorted(manifest.where("n_docs > 0").select("shard", "data", "index", "n_tokens").collect())
    base, rows = 0, []
    for s in shards:
        rows.append((s["data"], s["index"], base))
        base += s["n_tokens"]
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for row in batch.to_pylist():
                files, path = pafs.FileSystem.from_uri(row["data"])
                with files.open_input_stream(pafs.FileSystem.from_uri(row["index"])[1]) as f:
                    entries = np.frombuffer(f.read(), INDEX_ENTRY)
                starts = row["base"] + np.cumsum(entries["n"], dtype=np.int64) - entries["n"]
                with files.open_input_file(path) as f:
                    size, a = f.size(), 0
                    bounds = np.r_[entries["offset"].astype(np.int64), size]
                    while a < len(entries):
                        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 21), "right")) - 1)
                        data = memoryview(f.read_at(int(bounds[b] - bounds[a]), int(bounds[a])))
                        ids = [unpack(unframe(data, int(bounds[k] - bounds[a]))[0]) for k in range(a, b)]
                        cut = np.r_[0, np.cumsum([len(x) for x in ids])]
                        flat = np.concatenate(ids).astype(np.int32)
                        key = pa.array(entries["id"][a:b].astype(np.int64), mask=entries["null"][a:b].astype(bool))
                        yield pa.RecordBatch.from_arrays([key, pa.array(starts[a:b]), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat))], names=["id", "start", "ids"])
                        a = b

    paths = spark.createDataFrame(rows, "data string, index string, base long")
    if rows:
        paths = paths.repartition(len(rows))
    return paths.mapInArrow(run, out)


def checksums(records: DataFrame) -> DataFrame:
    """(id, start, n_tokens, crc32 of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            ids = batch.column(2)
            at = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return records.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
