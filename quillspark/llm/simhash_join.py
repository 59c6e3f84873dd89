"""Components of texts whose 64-bit SimHash fingerprints are near, by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit in the XXH64 hashes of a text's word
n-grams, repeats included.

Candidates come from Pagh's covering masks. The bits are dealt to the non-zero vectors
of r + 1 bits; the table of a non-zero vector v keeps the bits whose vector has an odd
product with v. At most r differing bits give r equations, which some v solves: in
that table all of them are masked out and the pair collides. So 2 ** (r + 1) - 1
tables (7 at radius 2, each keeping four sevenths of the bits) miss no pair.

Equal fingerprints are one before the tables. A bucket of more than ``BUCKET``
fingerprints is covered again, by masks over the bits that its table left out, and so
on: every level leaves three sevenths of them, so that after three levels a bucket has at
most 2 ** 6 different members, however near all texts are to each other. Members of
the other buckets are compared exactly, and a bucket yields the edges of a spanning
forest of its links, not its pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, discard, flat_text, steps, stored, tidy
from .packed_words import packed_words

BITS = 64
#: Members of a bucket that are compared with each other; larger ones are covered again.
BUCKET = 256
#: Grams that are hashed and counted at once.
STEP_GRAMS = 1 << 16
SEED = 42


def covering_masks(free: int, radius: int) -> list[int]:
    """Bits to keep of ``free`` in each table: of any ``radius`` bits of it, some table keeps none."""
    places = [k for k in range(BITS) if free >> k & 1]
    vectors = range(1, 1 << (radius + 1))
    dealt = [(1 << k, vectors[i % len(vectors)]) for i, k in enumerate(places)]
    return [sum(bit for bit, m in dealt if (m & v).bit_count() & 1) for v in vectors]


def _bits_of(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of the ranges."""
    import xxhash

    of = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(start), STEP_GRAMS):
        h = np.array([of(data[a:b], SEED) for a, b in zip(start[at : at + STEP_GRAMS].tolist(), end[at : at + STEP_GRAMS].tolist(), strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return total


def simhash(flat: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each text."""
    packed, at, count = packed_words(flat, offsets, lower=True)
    data = packed.tobytes()
    out = np.zeros(len(count), np.uint64)
    first = np.cumsum(count) - count
    for k, (a, words) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        if words:
            start = at[a : a + max(words - n, 0) + 1]
            end = at[a + min(n, words) : a + words + 1] - 1
            bits = np.packbits(2 * _bits_of(data, start, end) > len(start), bitorder="little")
            out[k] = bits.view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fp) for each row: the fingerprint as a signed number. A text without words has 0; one with fewer than ``n`` words is one gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            flat, offsets = flat_text(batch.column(1))
            for a, b in steps(offsets):
                fp = simhash(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches by the pairs."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        torn = a != b
        if not torn.any():
            return root
        i, j = i[torn], j[torn]
        np.minimum.at(root, np.maximum(a, b)[torn], np.minimum(a, b)[torn])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def bucket_links(fps: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, root) of the links within each of the buckets that lie one after another."""
    end = np.repeat(np.cumsum(size), size)
    live = np.arange(len(fps))
    left, right = [], []
    for d in range(1, int(size.max(initial=1))):
        live = live[live + d < end[live]]
        near = live[np.bitwise_count(fps[live] ^ fps[live + d]) <= radius]
        left.append(near)
        right.append(near + d)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    root = _roots(len(fps), i, j)
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[own], fps[root[own]]


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b) over ``buckets(members)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            lists = batch.column(0)
            at = lists.offsets.to_numpy()
            for a, b in steps(at, 1 << 16):
                fps = lists.values.to_numpy()[at[a] : at[b]].view(np.uint64)
                pair = bucket_links(fps, np.diff(at[a : b + 1]), radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pair], names=["a", "b"])

    return buckets.select("members").mapInArrow(run, "a long, b long")


def near_fingerprints(fps: DataFrame, radius: int = 2) -> list[DataFrame]:
    """Edges (a, b), in stored parts, that connect all different ``fps(fp)`` within the radius, directly or through others within it."""
    if not 0 <= radius < 6:
        raise ValueError("the radius goes from 0 to 5")
    word = (1 << BITS) - 1
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    # a path names the tables of all levels so far; their number doesn't depend on the rows
    kept = {0: 0}
    rows = fps.select(F.lit(0).cast("long").alias("path"), "fp")
    parts: list[DataFrame] = []
    over: DataFrame | None = None  # members of large buckets
    while True:
        below = [(path, path << (radius + 1) | v, mask | new) for path, mask in kept.items() for v, new in enumerate(covering_masks(word & ~mask, radius), 1)]
        table = lambda path, mask: F.struct(F.lit(path).cast("long").alias("path"), F.lit(signed(mask)).cast("long").alias("mask"))
        of_path = {up: F.array(*(table(path, mask) for u, path, mask in below if u == up)) for up in kept}
        tables = F.element_at(F.create_map(*(c for up, own in of_path.items() for c in (F.lit(up).cast("long"), own))), F.col("path"))
        dealt = rows.select("fp", F.explode(tables).alias("t")).select("t.path", F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp")
        size = dealt.groupBy("path", "key").agg(F.count("*").alias("c")).where("c > 1")
        met = stored(dealt.join(size, ["path", "key"]), "met")
        if over is not None:
            discard(over)
        small = met.where(F.col("c") <= BUCKET).groupBy("path", "key").agg(F.collect_list("fp").alias("members"))
        parts.append(stored(_links(small, radius).distinct(), "near"))
        large = met.where(F.col("c") > BUCKET)
        used = {r["path"] for r in large.select("path").distinct().collect()}
        if used:
            rows = over = stored(large.select("path", "fp"), "large")
            kept = {path: mask for _, path, mask in below if path in used}
        discard(met)
        if not used:
            return parts


def near_simhashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``.

    The fingerprint has 16 hex digits. Two rows link if their fingerprints differ in
    at most ``radius`` bits; the component is the smallest id that links reach.

    Null and empty texts, and those without words, have the fingerprint zero and link
    like any other. Equal texts have one fingerprint. Null ids are passed over in
    the minimum, which is null where a component has no other; repeated ids may
    stand for several texts and give a row each. Ids may be of any type that has
    an order. Other columns aren't read; an empty table gives none.
    """
    rows = stored(fingerprints(docs, id_col, text_col, n), "fingerprints")
    own = stored(rows.groupBy("fp").agg(F.min("id").alias("low")), "own")
    parts = near_fingerprints(own.select("fp"), radius)
    edges = functools.reduce(DataFrame.union, parts)
    linked = own.join(connected_components(edges).withColumnRenamed("id", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("low").alias("least"))
    of_fp = own.join(linked.select("fp", "component").join(least, "component").select("fp", F.struct("least").alias("found")), "fp", "left")
    # written, so that a join skewed by copies or empty texts can be split
    of_fp = stored(of_fp.select("fp", F.when(F.col("found").isNull(), F.col("low")).otherwise(F.col("found.least")).alias("component_id")), "of-fingerprint")
    discard(own, *parts)
    out = rows.join(of_fp, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
