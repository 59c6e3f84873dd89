"""Exact n-gram Jaccard join by grouped prefixes, for components of near duplicates.

A text is the set of its distinct word n-grams, ordered by an estimate of rarity:
the summed logarithms of its words' corpus counts (from a fixed-size count table
over all texts), then the hash. Sets that reach the threshold share a token in
their prefixes, the longer one's probing prefix and the shorter one's index
prefix. Equal sets are one; sets with equal prefixes and size are one group, and
only groups meet in the join. Tokens that the same groups have are one as well.

Components don't need every link, so the join has three rounds. In the first, each
token's groups meet only its pivot, the group that has the token earliest; what
passes the filters on sizes, positions, common prefix tokens and parity bitmaps
expands into member pairs and is verified on the texts. The second takes, where a
token's sets are not yet in one component, each set's nearest partners in others.
The third takes all pairs that are left between components, so no link between
them is lost, while a large cluster of copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bitmap, byte_values, connected_components, discard, flat_text, mix, odd_powers, ranges, steps, stored, tidy, trim

#: Cells of the word count table: 1 MB as codes of a byte, whatever the corpus.
CELL_BITS = 20
CHUNK_BITS = 12
#: Count tables that one group adds up.
FAN = 1000
#: Bits of the bitmaps of repeated tokens and candidate texts: 4 MB, whatever the corpus. They spare a shuffle of rows that
#: meet nothing, never the exact join behind them; of a corpus that fills them every row takes part in that join, once.
BITMAP_BITS = 25
#: Sets of a token that meet in one task are at most twice this many.
BLOCK = 2000
#: Words of pairs of sets that a task compares in one step: each of the about ten arrays of it takes up to 2 MB, however many sets meet.
CELLS = 1 << 18
#: Partners that a set keeps at a token in the second round.
NEAREST = 3
BASE = 0x5851F42D4C957F2D
_values = byte_values(0x1B873593)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lowered, and how many each text has."""
    n = len(flat)
    if len(_powers[0]) < n:
        _powers[:] = [odd_powers(n + (n >> 2), BASE), odd_powers(n + (n >> 2), pow(BASE, -1, 1 << 64))]
    gap = _space[flat]
    before = np.r_[True, gap[:-1]] if n else gap
    after = np.r_[gap[1:], True] if n else gap
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edge] = True
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_values[_lower[flat]] * _powers[0][:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _powers[1][start])
    return hashes, np.diff(np.searchsorted(start, offsets))


def shingles(flat: np.ndarray, offsets: np.ndarray, n: int, codes: np.ndarray | None = None, ordered: bool = False, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Distinct n-grams of each text, rarest first by ``codes``, and their n + 1 offsets; texts with fewer words have the whole sequence.

    With ``ordered`` also the place of each in the order, as a whole number (rarity, then the hash's high bits).
    ``known`` is what ``words`` gives, if it is at hand.
    """
    hashes, count = known or words(flat, offsets)
    first = np.cumsum(count) - count
    full = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), full)
    at = ranges(first, full)
    size = np.minimum(count, n)[doc]
    factor = odd_powers(n + 2, 0x9E3779B97F4A7C15)
    h = size.astype(np.uint64) * factor[n + 1]
    score = np.zeros(len(at), np.int64)
    padded = np.r_[hashes, np.zeros(n, np.uint64)]
    code = codes[(padded >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.int64) if codes is not None else None
    for k in range(n):
        inside = k < size
        h += np.where(inside, padded[at + k] * factor[k + 1], np.uint64(0))
        if code is not None:
            score += np.where(inside, code[at + k], 0)
    h = mix(h)
    order = np.lexsort((h, score, doc))
    h, doc, score = h[order], doc[order], score[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    h, doc, score = h[keep], doc[keep], score[keep]
    at = np.searchsorted(doc, np.arange(len(count) + 1))
    return (h, at, (score << 48) | (h >> np.uint64(16)).astype(np.int64)) if ordered else (h, at)


def _sums(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of each range."""
    total = np.r_[np.uint64(0), np.cumsum(h, dtype=np.uint64)]
    return total[at[1:]] - total[at[:-1]]


def set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, whatever the order of its members."""
    size = np.diff(at).astype(np.uint64)
    return mix(_sums(mix(h), at) + size), mix(_sums(mix(h ^ np.uint64(0xA0761D6478BD642F)), at) ^ (size * np.uint64(3)))


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(rows: DataFrame, n: int) -> DataFrame:
    """Of each row (id, k0, k1, size), and of each task the counts of word cells in chunks (chunk, part, cells)."""
    schema = pa.schema([("id", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("size", pa.int64()), ("chunk", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in tidy(batches):
            flat, offsets = flat_text(batch.column(1))
            for a, b in steps(offsets):
                part, cut = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                known = words(part, cut)
                cells += np.bincount((known[0] >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
                h, at = shingles(part, cut, n, known=known)
                k0, k1 = set_keys(h, at)
                none = [pa.nulls(b - a, t) for t in (pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _i64(k0), _i64(k1), pa.array(np.diff(at)), *none], schema=schema)
        own = [(k, c.astype("<i8").tobytes()) for k, c in enumerate(cells.reshape(-1, 1 << CHUNK_BITS)) if c.any()]
        if own:
            none = [pa.nulls(len(own), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in own], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(own), pa.int32()), pa.array([c for _, c in own], pa.binary())], schema=schema)

    return rows.mapInArrow(run, "id long, k0 long, k1 long, size long, chunk int, part int, cells binary")


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(1 << CHUNK_BITS, np.int64)
    for c in rows["cells"]:
        total += np.frombuffer(c.as_buffer(), "<i8")
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})


def word_codes(scanned: DataFrame) -> np.ndarray:
    """Four times the base-2 logarithm of each cell's count, as bytes; sums go up a tree, ``FAN`` parts of 32 KB at a time, whatever the number of tasks."""
    total = scanned.where("chunk is not null").select("chunk", "part", "cells")
    for step in (FAN, FAN, 1 << 31):
        total = total.withColumn("part", F.floor(F.col("part") / step).cast("int")).groupBy("chunk", "part").applyInArrow(_added, "chunk int, part int, cells binary")
    total = total.toArrow()
    cells = np.zeros((1 << (CELL_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.int64)
    for k, c in zip(total["chunk"].to_pylist(), total["cells"].to_pylist(), strict=True):
        cells[k] = np.frombuffer(c, "<i8")
    codes = np.minimum(4 * np.log2(cells.ravel() + 1), 255).astype(np.uint8)
    del total, cells
    trim()
    return codes


def _prefixes(rows: DataFrame, n: int, percent: int, codes: np.ndarray) -> DataFrame:
    """(k0, k1, t, g, size, last, bits, prefix) once for each set in a task; t is the hash of its text.

    g is the hash of prefix and size, last the place of the prefix's last token in
    the order, bits the parity bitmap of the set: at least two bits a member, a
    power of two, in each the parity of the members that hash there.
    """
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in tidy(batches):
            flat, offsets = flat_text(batch.column(1))
            for a, b in steps(offsets):
                h, at, order = shingles(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, shared.value, True)
                k0, k1 = set_keys(h, at)
                size = np.diff(at)
                length = np.where(size > 0, size - -(-size * percent // 100) + 1, 0)
                prefix = h[ranges(at[:-1], length)]
                cut = np.r_[0, np.cumsum(length)]
                g = mix(_sums(mix(prefix + np.uint64(1)), cut) + size.astype(np.uint64))
                fresh = []
                for i, key in enumerate(zip(k0.tolist(), k1.tolist(), strict=True)):
                    if size[i] and key not in seen:
                        seen.add(key)
                        fresh.append(i)
                last = np.r_[order, 0][np.where(size > 0, at[:-1] + length - 1, len(order))]
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), _i64(prefix))
                yield pa.RecordBatch.from_arrays([_i64(k0), _i64(k1), batch.column(2).slice(a, b - a), _i64(g), pa.array(size), pa.array(last), pa.array(_parity(h, at), pa.binary()), lists], names=["k0", "k1", "t", "g", "size", "last", "bits", "prefix"]).take(pa.array(fresh, pa.int64()))

    return rows.mapInArrow(run, "k0 long, k1 long, t long, g long, size long, last long, bits binary, prefix array<long>")


def _parity(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        bits = 1 << max(6, (2 * (b - a) - 1).bit_length())
        out.append(np.packbits((np.bincount((h[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def _close(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity bitmaps differ in no more bits than sets above the threshold may: each such bit stands for a member of one set alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            sizes = [batch.column(i).to_numpy() for i in (4, 5)]
            total = sizes[0] + sizes[1]
            most = total - 2 * -(-percent * total // (100 + percent))
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                small = min(len(x), len(y))  # a longer bitmap folds onto a shorter one
                x = np.bitwise_xor.reduce(x.reshape(-1, small), axis=0)
                y = np.bitwise_xor.reduce(y.reshape(-1, small), axis=0)
                keep[i] = int(np.bitwise_count(x ^ y).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a0", "a1", "b0", "b1"]).filter(pa.array(keep))

    own = prefixes.select("k0", "k1", "size", "bits").dropDuplicates(["k0", "k1"])
    left = own.select(F.col("k0").alias("a0"), F.col("k1").alias("a1"), F.col("size").alias("sa"), F.col("bits").alias("x"))
    right = own.select(F.col("k0").alias("b0"), F.col("k1").alias("b1"), F.col("size").alias("sb"), F.col("bits").alias("y"))
    rows = pairs.join(left, ["a0", "a1"]).join(right, ["b0", "b1"]).select("a0", "a1", "b0", "b1", "sa", "sb", "x", "y")
    return rows.mapInArrow(run, "a0 long, a1 long, b0 long, b1 long")


def _repeated_postings(prefixes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(g, size, pos, token) of the prefix tokens that the bitmap of repeated tokens holds: all of those, and few others."""
    shared = bitmap(repeated, "token", BITMAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                at = part.column(2).offsets.to_numpy()
                token = part.column(2).values.to_numpy()[at[0] : at[-1]]
                h = token & ((1 << BITMAP_BITS) - 1)
                hit = np.flatnonzero((shared.value[h >> 6] >> (h & 63)) & 1)
                row = np.searchsorted(at - at[0], hit, "right") - 1
                g, size = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(size), pa.array((hit - (at - at[0])[row]).astype(np.int32)), pa.array(token[hit])], names=["g", "size", "pos", "token"])

    return prefixes.select("g", "size", "prefix").mapInArrow(run, "g long, size long, pos int, token long")


def _classes(postings: DataFrame) -> DataFrame:
    """(token, g, size, pos, w): tokens that the same groups have are one, a class of w tokens with its first position in each group.

    Documents that share a passage share all its tokens, so there are far fewer
    classes than tokens. Classes are known by hash: tokens that it confuses give a
    class of more groups, in which pairs still meet, and no fewer.
    """
    hashes = [F.bit_xor(F.xxhash64(*c)) for c in (("g", "size"), ("size", "g"))]
    own = postings.groupBy("token").agg(F.count("*").alias("c"), *hashes).where("c > 1").toDF("token", "c", "h0", "h1")
    named = postings.join(own.select("token", F.xxhash64("c", "h0", "h1").alias("class")), "token")
    return named.groupBy(F.col("class").alias("token"), "g", "size").agg(F.min("pos").alias("pos"), F.count("*").alias("w"))


def _texts_of(rows: DataFrame, pairs: DataFrame, prefixes: DataFrame, n: int) -> DataFrame:
    """(k0, k1, text) of the sets in ``pairs``, and of some more: a bitmap of the hashes of their texts picks rows, each text once in a task."""
    keys = pairs.select(F.explode(F.array(F.struct(F.col("a0").alias("k0"), F.col("a1").alias("k1")), F.struct(F.col("b0").alias("k0"), F.col("b1").alias("k1")))).alias("k")).select("k.*").distinct()
    h = prefixes.select("k0", "k1", "t").join(keys, ["k0", "k1"], "left_semi").select(F.col("t").alias("h"))
    shared = bitmap(h, "h", BITMAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in tidy(batches):
            t = batch.column(2).to_numpy()
            h = t & ((1 << BITMAP_BITS) - 1)
            fresh = []
            for i in np.flatnonzero((shared.value[h >> 6] >> (h & 63)) & 1).tolist():
                if int(t[i]) not in seen:
                    seen.add(int(t[i]))
                    fresh.append(i)
            for a in range(0, len(fresh), 200):
                texts = batch.column(1).take(pa.array(fresh[a : a + 200]))
                k0, k1 = (_i64(k) for k in set_keys(*shingles(*flat_text(texts), n)))
                yield pa.RecordBatch.from_arrays([k0, k1, texts], names=["k0", "k1", "text"])

    # both sides of the check below read the same shuffle of these
    return rows.mapInArrow(run, "k0 long, k1 long, text string").dropDuplicates(["k0", "k1"])


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a0, a1, b0, b1) of sets whose Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                sets = [shingles(*flat_text(part.column(i)), n) for i in (4, 5)]
                row = np.concatenate([np.repeat(np.arange(len(part)), np.diff(at)) for _, at in sets])
                h = np.concatenate([h for h, _ in sets])
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=len(part))
                union = np.diff(sets[0][1]) + np.diff(sets[1][1]) - both
                yield pa.RecordBatch.from_arrays(part.columns[:4], names=["a0", "a1", "b0", "b1"]).filter(pa.array((both * 100 >= union * percent) & (union > 0)))

    left = texts.select(F.col("k0").alias("a0"), F.col("k1").alias("a1"), F.col("text").alias("x"))
    right = texts.select(F.col("k0").alias("b0"), F.col("k1").alias("b1"), F.col("text").alias("y"))
    rows = pairs.join(left, ["a0", "a1"]).join(right, ["b0", "b1"]).select("a0", "a1", "b0", "b1", "x", "y")
    return rows.mapInArrow(run, "a0 long, a1 long, b0 long, b1 long")


def _may_link(a: str, b: str, percent: int):
    """Filters on sizes and positions, with the token in the index prefix of the shorter set."""
    small, large = f"least({a}.size, {b}.size)", f"greatest({a}.size, {b}.size)"
    need = f"ceil({percent} * ({a}.size + {b}.size) / {100 + percent}.0d - 1e-9)"
    index = lambda t: f"({t}.pos <= {t}.size - ceil({2 * percent} * {t}.size / {100 + percent}.0d - 1e-9))"
    return F.expr(f"100 * {small} >= {percent} * {large} and least({a}.size - {a}.pos, {b}.size - {b}.pos) >= {need} and (({a}.size <= {b}.size and {index(a)}) or ({b}.size <= {a}.size and {index(b)}))")


def _group_pairs(met: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The distinct group pairs (ga, sa, gb, sb) whose common prefix tokens leave room for the overlap that the threshold needs.

    Tokens up to the end of the prefix that ends first are common only within both
    prefixes, so the overlap is at most the common prefix tokens plus what that set
    has behind its prefix.
    """
    schema = "ga long, sa long, gb long, sb long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            sizes = [batch.column(k).to_numpy() for k in (1, 3)]
            row, token, w = [], [], []
            for k in (4, 7):
                at = batch.column(k).offsets.to_numpy()
                row.append(np.repeat(np.arange(len(batch)), np.diff(at)))
                token.append(batch.column(k).values.to_numpy()[at[0] : at[-1]])
                w.append(batch.column(k + 1).values.to_numpy()[at[0] : at[-1]] if k == 4 else np.zeros(int(at[-1] - at[0]), np.int64))
            row, token, w = (np.concatenate(x) for x in (row, token, w))
            order = np.lexsort((token, row))
            row, token, w = row[order], token[order], w[order]
            same = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
            common = np.bincount(row[1:][same], (w[1:] + w[:-1])[same], len(batch))
            rest = [-(-percent * x // 100) - 1 for x in sizes]
            ends = [batch.column(k).to_numpy() for k in (6, 9)]
            room = np.where(ends[0] < ends[1], rest[0], np.where(ends[1] < ends[0], rest[1], np.maximum(*rest)))
            keep = common + room >= -(-percent * (sizes[0] + sizes[1]) // (100 + percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["ga", "sa", "gb", "sb"]).filter(pa.array(keep))

    pairs = met.select(F.col("p.g").alias("ga"), F.col("p.size").alias("sa"), F.col("q.g").alias("gb"), F.col("q.size").alias("sb")).distinct()
    side = lambda x: groups.select(F.col("g").alias(f"g{x}"), F.col("size").alias(f"s{x}"), F.transform("tokens", lambda t: t.token).alias(f"t{x}"), F.transform("tokens", lambda t: t.w).alias(f"w{x}"), F.col("last").alias(f"l{x}"))
    rows = pairs.join(side("a"), ["ga", "sa"]).join(side("b"), ["gb", "sb"]).select("ga", "sa", "gb", "sb", "ta", "wa", "la", "tb", "wb", "lb")
    return rows.mapInArrow(run, schema)


def _close_pairs(postings: DataFrame, own: DataFrame, prefixes: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Distinct pairs (a0, a1, b0, b1) of sets in different components that share a token and pass all filters.

    ``own(g, size, k0, k1, c)`` has the component of each set. With ``best`` each
    set keeps its nearest partners at a token by bitmap, so that rows grow with the
    sets. A token's sets, and a group's, meet in blocks of ``BLOCK``: a task holds
    two blocks, and a set is sent once for each block of its token.
    """
    by_group = own.groupBy("g", "size").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m"))
    open_ = postings.select("token", "g", "size", "pos").join(by_group, ["g", "size"])
    torn = open_.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.sum("m").alias("n")).where("l <> h and n > 2").select("token", "n")  # a pair alone met in the first round
    rows = open_.select("token", "g", "size", "pos").join(torn, "token").join(own, ["g", "size"])
    # members of a group have all their prefix in common: the group is a token of its own
    split = by_group.where("low <> high").select("g", "size", F.xxhash64("g", "size").alias("token"), F.lit(0).alias("pos"), F.col("m").alias("n")).join(own, ["g", "size"])
    rows = rows.select("token", "n", "size", "pos", "k0", "k1", "c").union(split.select("token", "n", "size", "pos", "k0", "k1", "c"))
    bits = prefixes.select("k0", "k1", "bits").dropDuplicates(["k0", "k1"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("k1", "k0"), blocks).cast("int")
    rows = rows.join(bits, ["k0", "k1"]).select("token", "size", "pos", "k0", "k1", "c", "bits", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("token", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).alias("second"), "size", "pos", "k0", "k1", "c", "bits")
    dealt = rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")

    def solve(part: pa.Table) -> pa.RecordBatch:
        size, pos, c = (part.column(k).to_numpy() for k in ("size", "pos", "c"))
        key = np.stack([part.column(k).to_numpy() for k in ("k0", "k1")], axis=1)
        second = part.column("second").to_numpy()
        diagonal = part.column("x")[0].as_py() == part.column("y")[0].as_py()
        left = np.arange(len(size)) if diagonal else np.flatnonzero(~second)
        right = left if diagonal else np.flatnonzero(second)
        raw = [np.frombuffer(b, np.uint8) for b in part.column("bits").to_pylist()]
        width = np.array([len(b) for b in raw])
        out: list[np.ndarray] = []
        for wide in np.unique(width).tolist():
            for narrow in np.unique(width).tolist():
                ia, ib = left[width[left] == wide], right[width[right] == narrow]
                w = min(wide, narrow)
                if not len(ia) or not len(ib) or max(wide, narrow) > 2 * w:
                    continue  # sizes that far apart fail the size filter
                folded = lambda i, w=w: np.stack([np.bitwise_xor.reduce(raw[k].reshape(-1, w), axis=0) for k in i])
                fa, fb = folded(ia).view(np.uint64 if w % 8 == 0 else np.uint8), folded(ib).view(np.uint64 if w % 8 == 0 else np.uint8)
                step = max(1, CELLS // max(1, fb.size))
                for at in range(0, len(ia), step):
                    own_, bits_ = ia[at : at + step], fa[at : at + step]
                    total = size[own_][:, None] + size[ib][None, :]
                    need = -(-percent * total // (100 + percent))
                    ok = (c[own_][:, None] != c[ib][None, :]) & (np.minimum((size - pos)[own_][:, None], (size - pos)[ib][None, :]) >= need)
                    ok &= 100 * np.minimum(size[own_][:, None], size[ib][None, :]) >= percent * np.maximum(size[own_][:, None], size[ib][None, :])
                    if not ok.any():
                        continue
                    far = np.bitwise_count(bits_[:, None, :] ^ fb[None, :, :]).sum(axis=2, dtype=np.int64)
                    ok &= far <= total - 2 * need
                    if best is not None and ok.sum(axis=1).max() > best:
                        nearest = np.argsort(np.where(ok, far, 1 << 40), axis=1, kind="stable")[:, :best]
                        kept = np.zeros_like(ok)
                        np.put_along_axis(kept, nearest, True, axis=1)
                        ok &= kept
                    i, j = np.nonzero(ok)
                    out.append(np.concatenate([key[own_[i]], key[ib[j]]], axis=1))
        pairs = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        swap = (pairs[:, 0] > pairs[:, 2]) | ((pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] > pairs[:, 3]))
        pairs[swap] = pairs[swap][:, [2, 3, 0, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(4)], names=["a0", "a1", "b0", "b1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in tidy(batches):
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            at = np.stack([table.column(k).to_numpy() for k in ("token", "x", "y")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist()]
            done = [solve(table.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches(max_chunksize=100_000)
            held = table.slice(cuts[-1])
        if held is not None and len(held):
            yield solve(held)

    return dealt.mapInArrow(run, "a0 long, a1 long, b0 long, b1 long").distinct()


def near_duplicate_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The set of each row, the component of each linked set, and the links.

    (id, k0, k1, size); (k0, k1, component); (a0, a1, b0, b1). A link is a pair of
    different sets of which 100 times the intersection is at least ``percent``
    times the union. Equal sets have one key. Links that join sets which are
    already in one component may be left out.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent goes from 50 to 100")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("t"))
    scanned = stored(_scan(rows, n), "sets")
    codes = word_codes(scanned)
    sets = scanned.where("chunk is null").select("id", "k0", "k1", "size")
    prefixes = stored(_prefixes(rows, n, percent, codes), "prefixes")
    members = prefixes.select("g", "size", "k0", "k1").distinct()
    repeated = prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    postings = _repeated_postings(prefixes, repeated).distinct()
    postings = stored(_classes(postings), "postings")
    ends = prefixes.groupBy("g", "size").agg(F.max("last").alias("last"))
    groups = stored(postings.groupBy("g", "size").agg(F.collect_list(F.struct("token", "w")).alias("tokens")).join(ends, ["g", "size"]), "groups")
    # the pivot of a token is the group that has it first
    first = F.min_by(F.struct("g", "size", "pos"), F.struct("pos", "g", "size")).alias("q")
    pivots = postings.groupBy("token").agg(first).select("token", "q.g", "q.size", "q.pos")

    met = postings.alias("p").join(pivots.alias("q"), "token").where("p.g <> q.g or p.size <> q.size").where(_may_link("p", "q", percent))
    met = _group_pairs(met, groups, percent)
    first = members.groupBy("g", "size").agg(F.min(F.struct("k0", "k1")).alias("m"), F.count("*").alias("c")).where("c > 1")
    inside = members.join(first, ["g", "size"]).where("k0 <> m.k0 or k1 <> m.k1").select("k0", "k1", "m.k0", "m.k1").toDF("a0", "a1", "b0", "b1")
    pairs = stored(_close(_expanded(met, members).union(inside), prefixes, percent), "pairs")
    links = stored(_verified(pairs, _texts_of(rows, pairs, prefixes, n), n, percent), "links")
    discard(groups, pairs)

    name = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    edges = lambda x: x.select(name("a0", "a1").alias("a"), name("b0", "b1").alias("b"))
    components = stored(connected_components(edges(links)), "components")

    # further rounds: first each set's nearest partners in other components, then all that are left
    for best in (NEAREST, None):
        own = members.withColumn("id", name("k0", "k1")).join(components, "id", "left").select("g", "size", "k0", "k1", F.xxhash64(F.coalesce("component", "id")).alias("c"))
        near = stored(_close_pairs(postings, own, prefixes, percent, best), "more")
        if near.isEmpty():
            continue
        more = stored(_verified(near, _texts_of(rows, near, prefixes, n), n, percent), "links")
        discard(near)
        if not more.isEmpty():
            links = links.union(more)
            # links so far are one edge a set now
            known = components.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
            components = stored(connected_components(known.union(edges(more))), "components")
    discard(prefixes, postings)
    half = lambda at: F.conv(F.substring("id", at, 16), 16, -10).cast("long")
    return sets, components.select(half(1).alias("k0"), half(17).alias("k1"), "component"), links


def _expanded(met: DataFrame, members: DataFrame) -> DataFrame:
    """Member pairs of group pairs."""
    a = members.select(F.col("g").alias("ga"), F.col("size").alias("sa"), F.col("k0").alias("a0"), F.col("k1").alias("a1"))
    b = members.select(F.col("g").alias("gb"), F.col("size").alias("sb"), F.col("k0").alias("b0"), F.col("k1").alias("b1"))
    return met.join(a, ["ga", "sa"]).join(b, ["gb", "sb"]).select("a0", "a1", "b0", "b1")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    The component is the smallest id that links reach, through equal sets too.
    Null and empty texts, and those without words, have no shingles and stay
    alone. Null ids are passed over in the minimum; repeated ids may stand for
    several texts and give a row each. Other columns aren't read; an empty table
    gives none.
    """
    sets, components, _ = near_duplicate_sets(docs, id_col, text_col, n, percent)
    # the smallest id of each set first, then of its component: nothing is gathered by a component but minima
    own = sets.where("size > 0").groupBy("k0", "k1").agg(F.min("id").alias("low"))
    linked = own.join(components, ["k0", "k1"])
    least = linked.groupBy("component").agg(F.min("low").alias("least"))
    of_set = own.join(linked.select("k0", "k1", "component").join(least, "component").select("k0", "k1", "least"), ["k0", "k1"], "left").select("k0", "k1", F.coalesce("least", "low").alias("component_id"))
    # written, so that a join skewed by copies or empty texts can be split
    out = sets.join(stored(of_set, "of-set"), ["k0", "k1"], "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
