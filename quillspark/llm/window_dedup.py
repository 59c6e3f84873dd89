"""Removal of byte windows that repeat anywhere in the corpus, by a depth-limited radix sort of suffixes.

Suffixes are ordered only as far as the threshold, ``width`` bytes, and in passes
from the most significant digit on; a group that is down to one suffix leaves.

1. The first digit of a window is its anchor: the ``ANCHOR``-byte string in it
   whose hash is least, leftmost on ties. Windows next to each other mostly share
   one anchor occurrence and are carried as one run, so that a byte costs about a
   hundredth of a row.
2. The second digit is the hash of a whole run's bytes. An anchor whose
   occurrences all have equal runs is done: alone, nothing repeats; else all does.
3. Where runs of an anchor differ, the bytes of one occurrence of each distinct run
   are dealt by anchor, and a task sorts the windows of its anchors by passes over
   8-byte digits. Groups left after the last digit are exactly the repeated windows.
   A group of more than ``CROWD`` distinct runs is first dealt by its next 8 bytes,
   as often as it takes: those behind the anchor for windows that hold them, else
   those in front of it. Equal windows have their anchor at the same place, so they
   stay together; a group whose bytes are all dealt out is a repeated window.

The first two digits are 64-bit hashes; runs count as equal if anchor and run
hashes both agree. Their counts are pre-aggregated. Texts that hold no repeated anchor never move: a bitmap of fixed size
tells most of them apart, and only costs more shuffle where it errs.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bitmap, byte_values, discard, flat_text, mix, odd_powers, ranges, steps, stored, tidy

WIDTH = 200
ANCHOR = 32
#: Longer texts are cut into overlapping pieces of this many window starts; positions in a piece fit 20 bits.
PIECE = 400_000
LOW = np.uint64((1 << 20) - 1)
BASE = 0x5851F42D4C957F2D  # odd
INVERSE = pow(BASE, -1, 1 << 64)
#: Bits of the bitmaps of repeated anchors and of texts that have some: 8 MB, whatever the corpus.
BITMAP_BITS = 26
#: Most distinct runs that one task sorts (each has at most 369 bytes: 7 MB); larger groups are dealt by further digits.
CROWD = 20_000
#: Bytes of a digit by which a group is dealt.
DIGIT = 8
#: Windows that one radix sort orders at once.
STEP_WINDOWS = 200_000

_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_values = byte_values(0x2545F491)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the worker."""
    if len(_powers[0]) < n:
        _powers[:] = [odd_powers(n + (n >> 2), BASE), odd_powers(n + (n >> 2), INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(flat: np.ndarray) -> np.ndarray:
    """n + 1 sums from which the hash of any range of bytes follows."""
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_values[flat] * powers(len(flat))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, wherever they stand."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row: two running minima over blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def pieces(flat: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, piece offsets, row of each piece, its place in the text): steps in which each window lies in one piece."""
    for a, b in steps(offsets, PIECE):
        size = int(offsets[b] - offsets[a])
        if b - a > 1 or size <= PIECE + width - 1:
            yield flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.arange(a, b), np.zeros(b - a, np.int64)
            continue
        for at in range(0, size, PIECE):
            part = flat[offsets[a] + at : min(offsets[b], offsets[a] + at + PIECE + width - 1)]
            if len(part) >= width:
                yield part, np.array([0, len(part)]), np.array([a]), np.array([at])


def runs(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor occurrence: (piece, first start, last start, anchor hash, run hash), starts within the piece."""
    n = len(flat)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    k = min(ANCHOR, width)
    sums = prefix_sums(flat)
    at = np.arange(n - k + 1)
    grams = mix(range_hash(sums, at, at + k))
    least = _sliding_min((grams & ~LOW) | at.astype(np.uint64), width - k + 1)
    anchor = (least & LOW).astype(np.int64)
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - width + 1, 0)
    window = ranges(offsets[:-1], starts)
    piece = np.repeat(np.arange(len(sizes)), starts)
    anchor = anchor[window]
    if not len(window):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(window)] - 1
    lo, hi, a = window[first], window[last], anchor[first]
    shape = ((a - lo) * 256 + (hi - lo)).astype(np.uint64)
    whole = mix(range_hash(sums, lo, hi + width) ^ mix(shape + np.uint64(1)))
    own = offsets[piece[first]]
    return piece[first], lo - own, hi - own, grams[a], whole


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def text_key(text) -> list:
    """Two 64-bit hashes by which equal texts are known."""
    return [F.xxhash64(text).alias("k0"), F.xxhash64(F.lit(1), text).alias("k1")]


def anchor_runs(texts: DataFrame, width: int) -> DataFrame:
    """(anchor, run, k0, k1, place) of every run in ``texts(k0, k1, text)``; place is 256 times the first start plus the number of further starts.

    A task gives the runs of a text twice at most: more copies tell nothing new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, int]] = Counter()
        for batch in tidy(batches):
            again = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                seen[key] += 1
                if seen[key] < 3:
                    again.append(i)
            batch = batch.take(pa.array(again, pa.int64()))
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            flat, offsets = flat_text(batch.column(2))
            for part, cut, rows, shift in pieces(flat, offsets, width):
                piece, lo, hi, anchor, whole = runs(part, cut, width)
                if len(piece):
                    row = rows[piece]
                    yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(whole), pa.array(keys[0][row]), pa.array(keys[1][row]), pa.array((lo + shift[piece]) * 256 + (hi - lo))], names=["anchor", "run", "k0", "k1", "place"])

    return texts.mapInArrow(run, "anchor long, run long, k0 long, k1 long, place long")


def _perhaps_repeated(found: DataFrame) -> DataFrame:
    """The runs whose anchor the bitmap of repeated anchors holds: all of those, and few others."""
    repeated = found.select("anchor").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    shared = bitmap(repeated, "anchor", BITMAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in tidy(batches):
            h = batch.column(0).to_numpy() & ((1 << BITMAP_BITS) - 1)
            yield batch.filter(pa.array(((bits[h >> 6] >> (h & 63)) & 1).astype(bool)))

    return found.mapInArrow(run, found.schema)


def _held(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose key the bitmap of ``keys`` may hold, one copy of a text a task."""
    shared = bitmap(keys, "k0", BITMAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in tidy(batches):
            k0, k1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            h = k0 & ((1 << BITMAP_BITS) - 1)
            hit = np.flatnonzero((bits[h >> 6] >> (h & 63)) & 1)
            fresh = []
            for i in hit.tolist():
                key = (int(k0[i]), int(k1[i]))
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if fresh:
                yield batch.take(pa.array(fresh))

    return texts.mapInArrow(run, "k0 long, k1 long, text string")


def _run_bytes(texts: DataFrame, width: int) -> DataFrame:
    """(anchor, k0, k1, place, alone, crowd, bytes) of chosen runs: ``texts(k0, k1, text, runs array<(anchor, place, alone, crowd)>)``."""
    schema = pa.schema([("anchor", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("place", pa.int64()), ("alone", pa.bool_()), ("crowd", pa.bool_()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for a in range(0, len(batch), 500):
                out = []
                for row in batch.slice(a, 500).to_pylist():
                    raw = row["text"].encode()
                    out += [(r["anchor"], row["k0"], row["k1"], r["place"], r["alone"], r["crowd"], raw[r["place"] >> 8 : (r["place"] >> 8) + (r["place"] & 255) + width]) for r in row["runs"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return texts.mapInArrow(run, "anchor long, k0 long, k1 long, place long, alone boolean, crowd boolean, bytes binary")


def radix_groups(flat: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows that start at ``starts`` equal another of their group: passes over 8-byte digits, the first the most significant."""
    v = np.r_[flat, np.zeros(8, np.uint8)].astype(np.uint64)
    digit = np.zeros(len(flat), np.uint64)
    for k in range(8):
        digit = (digit << np.uint64(8)) | v[k : k + len(flat)]
    left = np.arange(len(starts))
    for at in [*range(0, width - 7, 8), *([width - 8] if width % 8 and width > 8 else [])] if width >= 8 else range(width):
        d = digit[starts[left] + at] if width >= 8 else v[starts[left] + at]
        order = np.lexsort((d, group))
        left, group, d = left[order], group[order], d[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (d[1:] != d[:-1])]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        left, group = left[many], group[many]
        if not len(left):
            break
    out = np.zeros(len(starts), bool)
    out[left] = True
    return out


def _sorted_runs(rows: DataFrame, width: int) -> DataFrame:
    """(k0, k1, place) of stretches of repeated windows in lone runs; ``rows(key, k0, k1, place, alone, bytes, first, last)`` lie by key in order, and of a run the windows from first to last count."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        group = _groups(part.column("key"))
        same = np.r_[False, np.logical_and.reduce([group[1:] == group[:-1], *((x := part.column(c).to_numpy())[1:] == x[:-1] for c in ("k0", "k1", "place"))])]
        part, group = part.filter(pa.array(~same)).combine_chunks(), group[~same]
        flat, offsets = flat_text_bytes(part.column("bytes"))
        place, from_ = part.column("place").to_numpy(), part.column("first").to_numpy()
        times = part.column("last").to_numpy() - from_ + 1
        row = np.repeat(np.arange(len(place)), times)
        starts = ranges(offsets[:-1] + from_, times)
        hit = np.zeros(len(starts), bool)
        many = -(-len(starts) // (2 * STEP_WINDOWS))
        # windows are first dealt by their first bytes, so that a sort stays small
        deal = mix(range_hash(prefix_sums(flat), starts, starts + min(8, width))) % np.uint64(many) if many > 1 else np.zeros(1, np.uint64)
        for k in range(many):
            own = np.flatnonzero(deal == k) if many > 1 else np.arange(len(starts))
            hit[own] = radix_groups(flat, starts[own], group[row[own]], width)
        hit &= part.column("alone").to_numpy()[row]
        first = np.flatnonzero(hit & ~np.r_[False, hit[:-1] & (row[1:] == row[:-1])])
        last = np.flatnonzero(hit & ~np.r_[hit[1:] & (row[1:] == row[:-1]), False])
        own = row[first]
        where = ((place[own] >> 8) + starts[first] - offsets[own]) * 256 + (last - first)
        return pa.RecordBatch.from_arrays([pa.array(part.column("k0").to_numpy()[own]), pa.array(part.column("k1").to_numpy()[own]), pa.array(where)], names=["k0", "k1", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in tidy(batches):
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                held.append(part)
                n += len(part)
                if n * 100 < STEP_WINDOWS:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                group = _groups(table.column("key"))
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield solve(table.slice(0, cut).combine_chunks())
                held, n = table.slice(cut).to_batches(), len(table) - cut
        if n:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, "k0 long, k1 long, place long")


def flat_text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and their n + 1 offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def _groups(key: pa.ChunkedArray) -> np.ndarray:
    """A number for each row that goes up where the key changes."""
    number = key.combine_chunks().dictionary_encode().indices.to_numpy()
    return np.cumsum(np.r_[0, number[1:] != number[:-1]])


def _anchor_places(part: pa.RecordBatch, width: int) -> np.ndarray:
    """Where the anchor stands in the bytes of each run: the least gram of its first window, leftmost on ties."""
    k = min(ANCHOR, width)
    flat, offsets = flat_text_bytes(part.column(5))
    at = offsets[:-1, None] + np.arange(width - k + 1)
    grams = mix(range_hash(prefix_sums(flat), at.ravel(), at.ravel() + k)).reshape(at.shape)
    return np.argmin(grams & ~LOW, axis=1)


#: Runs of groups that are dealt further: of windows with low to high bytes in front of the anchor, the left bytes next to it and the right bytes behind it are in the key.
DEALT = "key binary, k0 long, k1 long, place long, alone boolean, bytes binary, anchor_at long, left int, right int, low int, high int"


def _undealt(rows: DataFrame, width: int) -> DataFrame:
    """Runs with their anchors' bytes as the key."""
    k = min(ANCHOR, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                at = _anchor_places(part, width)
                keys = [raw[i : i + k] for raw, i in zip(part.column(5).to_pylist(), at.tolist(), strict=True)]
                whole = lambda v: pa.array([v] * len(keys), pa.int32())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *part.columns[1:], pa.array(at), whole(0), whole(0), whole(0), whole(width - k)], names=["key", "k0", "k1", "place", "alone", "bytes", "anchor_at", "left", "right", "low", "high"])

    return rows.select("anchor", "k0", "k1", "place", "alone", "bytes").mapInArrow(run, DEALT)


def next_digits(raw: bytes, at: int, windows: int, left: int, right: int, low: int, high: int, width: int) -> Iterator[tuple[bytes, int, int, int, int]]:
    """(digit, left, right, low, high): the one or two groups to which a run's windows go by their next bytes.

    Windows that hold the next ``DIGIT`` bytes behind the anchor go by those, the others by
    the bytes in front of it; digits at a window's edge are shorter. Nothing for a
    run that has none of the windows.
    """
    k = min(ANCHOR, width)
    free = width - k
    mine = range(max(low, at - windows + 1), min(high, at) + 1)
    behind = min(right + DIGIT, free - low)
    top = min(high, free - behind) if behind > right else low - 1
    if mine and mine[0] <= top:
        yield b"R" + raw[at + k + right : at + k + behind], left, behind, low, top
    if mine and mine[-1] > top:
        rest = top + 1
        front = min(left + DIGIT, rest)
        yield b"L" + raw[at - front : at - left], front, right, rest, high


def _dealt(rows: DataFrame, width: int) -> DataFrame:
    """The runs of ``DEALT`` by their next digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for a in range(0, len(batch), 1000):
                out = []
                for r in batch.slice(a, 1000).to_pylist():
                    for digit, left, right, low, high in next_digits(r["bytes"], r["anchor_at"], (r["place"] & 255) + 1, r["left"], r["right"], r["low"], r["high"], width):
                        out.append(r | {"key": r["key"] + digit, "left": left, "right": right, "low": low, "high": high})
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return rows.mapInArrow(run, DEALT)


def _crowds(rows: DataFrame, width: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(rows for ``_sorted_runs``, (k0, k1, place) of repeated windows) of runs whose groups are too large for a task."""
    free = width - min(ANCHOR, width)
    sorted_, found = [], []
    rows = _undealt(rows, width)
    while True:
        own = F.xxhash64("k0", "k1", "place")
        dealt = stored(_dealt(rows, width), "dealt")
        size = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("key", "n")
        dealt = stored(dealt.join(size, "key"), "digits")  # the counts are joined from a table, so that the hot keys can be split
        out = (F.col("left") == F.col("low")) & (F.col("right") == free - F.col("low")) & (F.col("low") == F.col("high"))
        at = F.col("anchor_at")
        windows = F.col("place").bitwiseAND(255)
        first, last = F.greatest(at - F.col("high"), F.lit(0)), F.least(at - F.col("low"), windows)
        sorted_.append(dealt.where(~out & (F.col("n") <= CROWD)).select("key", "k0", "k1", "place", "alone", "bytes", first.cast("long").alias("first"), last.cast("long").alias("last")))
        found.append(dealt.where(out & F.col("alone")).select("k0", "k1", ((F.shiftright("place", 8) + at - F.col("low")) * 256).alias("place")))
        rows = dealt.where(~out & (F.col("n") > CROWD)).drop("n")
        if rows.isEmpty():
            return sorted_, found


def _cut(texts: DataFrame, width: int) -> DataFrame:
    """(k0, k1, spans, kept) of ``texts(k0, k1, text, places array<long>)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            out = []
            for row in (r for a in range(0, len(batch), 500) for r in batch.slice(a, 500).to_pylist()):
                raw = row["text"].encode()
                places = np.array(row["places"], np.int64)
                edge = np.zeros(len(raw) + 2, np.int32)
                np.add.at(edge, places >> 8, 1)
                np.add.at(edge, (places >> 8) + (places & 255) + width, -1)
                gone = np.cumsum(edge)[: len(raw)] > 0
                turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append({"k0": row["k0"], "k1": row["k1"], "spans": [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()], "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]))

    return texts.mapInArrow(run, "k0 long, k1 long, spans array<struct<start: long, end: long>>, kept binary")


def repeated_windows(docs: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(k0, k1, spans, kept) for each distinct text of which something repeats.

    ``spans`` are the maximal byte ranges covered by ``width``-byte strings that
    start at another place too, in any row, the same one included; ``kept`` is the
    rest of the text's UTF-8 bytes. ``k0, k1`` are ``text_key`` of the text: equal
    texts have equal results, so rows need no id, and repeated rows are repeats.
    Null and short texts have no windows; other columns are not read; an empty
    table gives none.
    """
    texts = docs.select(*text_key(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = stored(anchor_runs(texts, width), "runs")
    found = perhaps = stored(_perhaps_repeated(every), "perhaps")
    discard(every)
    # a hot anchor's runs are counted before anything is dealt by anchors, and the counts are a table, so that skewed joins can be split
    kinds = stored(found.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(F.struct("k0", "k1", "place")).alias("at")), "kinds")
    mixed = stored(kinds.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor", (F.col("c") > CROWD).alias("crowd")), "mixed")
    # a run that stands twice is repeated as a whole; of an anchor's different runs one occurrence each is sorted
    full = stored(found.join(kinds.where("n > 1").select("anchor", "run"), ["anchor", "run"]).select("k0", "k1", "place"), "full")
    distinct = stored(kinds.join(mixed, "anchor").select("anchor", "n", "at", "crowd"), "distinct")
    discard(perhaps, kinds)
    texts = stored(_held(texts, full.select("k0").union(distinct.select("at.k0"))), "texts")
    wanted = distinct.select("at.k0", "at.k1", F.struct("anchor", "at.place", (F.col("n") == 1).alias("alone"), "crowd").alias("r")).groupBy("k0", "k1").agg(F.collect_list("r").alias("runs"))
    # a text that came from several tasks gives its runs several times
    chosen = _run_bytes(texts.join(wanted, ["k0", "k1"]), width)
    crowded = not mixed.where("crowd").isEmpty()
    if crowded:
        chosen = stored(chosen, "chosen")
    whole = F.col("place").bitwiseAND(255)
    rows = chosen.where("not crowd").select(F.unhex(F.lpad(F.hex("anchor"), 16, "0")).alias("key"), "k0", "k1", "place", "alone", "bytes", F.lit(0).cast("long").alias("first"), whole.alias("last"))
    found = full
    if crowded:
        more, ends = _crowds(chosen.where("crowd"), width)
        rows, found = functools.reduce(DataFrame.union, [rows, *more]), functools.reduce(DataFrame.union, [full, *ends])
    single = _sorted_runs(rows.repartition("key").sortWithinPartitions("key", "k0", "k1", "place"), width)
    places = found.union(single).distinct().groupBy("k0", "k1").agg(F.collect_list("place").alias("places"))
    return _cut(texts.join(places, ["k0", "k1"]), width).dropDuplicates(["k0", "k1"])
