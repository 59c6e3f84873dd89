"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit verification.

Texts are words (letters and digits, A-Z lowered, marks dropped). The random-walk
embedding of Chakraborty, Goldenberg and Koucky writes the symbol under a pointer
at each step and moves the pointer on by a random bit of (step, symbol), which
maps small edit distance to small Hamming distance. A table samples a few steps;
its key is the symbols written there. Items are covered by windows of the largest of
``WINDOWS`` that fits them, at every offset; so are documents.
Windows whose keys agree in any table give a region, where the exact edit distance
between the item and the best stretch of the document decides.

Windows of documents with too few words of any item can't lie in a match and are
not embedded. The number of tables is the least that reaches ``RECALL`` for items of
each length with as many random edits as the threshold allows, in a seeded
simulation. Lengths that miss it with ``MOST_TABLES`` tables are searched exactly
instead: of an item cut in one piece more than its edits, one piece stays whole in
every match, so all places of a piece are verified. ``Index.recall`` has what was
reached, by item length; ``Index.exact`` the lengths searched by pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import byte_values, flat_text, mix, odd_powers, ranges, steps, tidy, trim

#: Window sizes; an item takes the largest that it has.
WINDOWS = (1, 2, 3, 4, 6, 8, 12, 16)
SAMPLES = 4
#: Tables of a window size; lengths that need more are searched exactly.
MOST_TABLES = 8
RECALL = 0.97
#: Items with random edits that recall is measured on, for each item length.
SIMULATED = 200
#: Items of so many words and more have ever more windows of the same share of edits: the shortest of them stand for all.
LONG_ITEM = 80
#: Edits allowed, as a share of the item's words.
EDITS = 0.2
#: Items that are broadcast at once: benchmarks with more text are searched in blocks of this many bytes.
BLOCK_BYTES = 16 << 20

BASE = 0x5851F42D4C957F2D
_values = byte_values(0x3C6EF372)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_word = np.zeros(256, bool)
_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the n + 1 offsets of texts among them."""
    n = len(flat)
    if len(_powers[0]) < n:
        _powers[:] = [odd_powers(n + (n >> 2), BASE), odd_powers(n + (n >> 2), pow(BASE, -1, 1 << 64))]
    inside = _word[flat]
    before = np.r_[True, ~inside[:-1]] if n else inside
    after = np.r_[~inside[1:], True] if n else inside
    some = offsets[:-1] < offsets[1:]
    before[offsets[:-1][some]] = True
    after[offsets[1:][some] - 1] = True
    start, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_values[_lower[flat]] * _powers[0][:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers[1][start]), np.searchsorted(start, offsets)


def unknown_words(size: int, edits: int, w: int) -> int:
    """The unknown words that a match's least-edited window holds in the worst arrangement of the edits."""
    if size >= LONG_ITEM:  # a bound: windows that don't overlap share the edits
        return min(w, max((edits - gone) // ((size - gone) // w) if size - gone >= w else w - size + edits for gone in range(edits + 1)))
    for most in range(min(edits, w), 0, -1):
        for gone in range(edits + 1):  # deleted words shorten the match, the other edits are unknown words
            n = size - gone
            if n < w:  # words beside the match fill the window
                if w - n + edits - gone >= most:
                    return most
                continue
            # the least number of places of which every window holds ``most``: as far right as can be
            places: list[int] = []
            for a in range(n - w + 1):
                inside = sum(x >= a for x in places[-w:])
                b = a + w
                while inside < most:
                    b -= 1
                    if b not in places[-w:]:
                        places.append(b)
                        inside += 1
                places.sort()
                if len(places) > edits - gone:
                    break
            if len(places) <= edits - gone:
                return most
    return 0


class Index:
    """Items, their vocabulary, and the LSH tables of their windows."""

    def __init__(self, ids: list, texts: list[str | None], edits: float = EDITS, recall: float = RECALL, seed: int = 1) -> None:
        flat, offsets = flat_text(pa.array([t or "" for t in texts], pa.string()))
        hashes, self.at = word_hashes(flat, offsets)
        self.ids, self.edits = ids, edits
        self.words = np.unique(hashes)
        self.oov, self.pad = len(self.words), len(self.words) + 1
        self.symbols = np.searchsorted(self.words, hashes)
        self.sizes = np.diff(self.at)
        # a table of the hashes' high bits turns most other words away
        self.high = np.zeros(1 << 16, bool)
        self.high[(self.words >> np.uint64(48)).astype(np.int64)] = True
        self.rng = np.random.default_rng(seed)
        self.window = np.r_[0, WINDOWS][np.searchsorted(WINDOWS, self.sizes, "right")]
        self.tables: dict[int, list[tuple]] = {}
        self.recall: dict[int, float] = {}
        self.exact: list[int] = []
        #: by window size, unknown words in the window of a match that has fewest, at most
        self.unknown: dict[int, int] = {}
        #: words behind each text, for matches with fewer words than a window
        self.gap = 0
        for w in sorted(set(self.window.tolist()) - {0}):
            self._build(w, recall)
        self.pieces = self._pieces()

    def allowed(self, size: int) -> int:
        return int(size * self.edits)

    def _build(self, w: int, recall: float) -> None:
        items = np.flatnonzero(self.window == w)
        most = (self.sizes[items] * self.edits).astype(np.int64)
        self.gap = max(self.gap, int((w - self.sizes[items] + most).max()))
        count = self.sizes[items] - w + 1
        start = ranges(self.at[items], count)
        item = np.repeat(items, count)
        windows = self.symbols[start[:, None] + np.arange(w)]
        offset = start - self.at[item]
        copies, owner, group = self._copies(items, w)
        n = np.array([len(c) - w + 1 for c in copies])
        flat, at = np.concatenate(copies), np.r_[0, np.cumsum([len(c) for c in copies])]
        own = flat[ranges(at[:-1], n)[:, None] + np.arange(w)]
        copy = np.repeat(np.arange(len(copies)), n)
        self.unknown[w] = max(unknown_words(k, self.allowed(k), w) for k in np.unique(self.sizes[items]).tolist())
        seen = (own == self.oov).sum(axis=1) <= self.unknown[w]
        own, copy = own[seen], copy[seen]
        found = np.zeros(len(copies), bool)
        reached = lambda: np.bincount(group, found) / np.bincount(group)
        tables = self.tables[w] = []
        # steps close together write the same few words, whose keys are common
        walk = w + w // 2
        samples = min(SAMPLES, walk)
        apart = max(1, walk // (2 * samples))
        while len(tables) < MOST_TABLES and (len(tables) < 2 or reached().min() < recall):
            where = np.sort(self.rng.choice(walk - (samples - 1) * (apart - 1), samples, replace=False)) + (apart - 1) * np.arange(samples)
            bits = self.rng.integers(0, 2, (int(where[-1]) + 1, self.pad + 1)).astype(np.int8)
            bits[:, self.pad] = 0
            keys = self._keys(windows, where, bits)
            order = np.argsort(keys, kind="stable")
            tables.append((where, bits, keys[order], item[order], offset[order]))
            key = self._keys(own, where, bits)
            lo, hi = np.searchsorted(tables[-1][2], key, "left"), np.searchsorted(tables[-1][2], key, "right")
            of = np.repeat(copy, hi - lo)
            found[of[tables[-1][3][ranges(lo, hi - lo)] == owner[of]]] = True
        share = reached()
        sizes = np.minimum(self.sizes[items], LONG_ITEM)
        lengths = np.unique(sizes)
        missed = lengths[share < recall]
        self.exact += np.unique(self.sizes[items[np.isin(sizes, missed)]]).tolist()
        self.recall |= {int(k): 1.0 if v < recall else float(v) for k, v in zip(lengths, share, strict=True)}
        # items searched by pieces leave the tables
        for k, (where, bits, keys, ids, shift) in enumerate(tables):
            stay = ~np.isin(self.sizes[ids], self.exact)
            high = np.zeros(1 << 16, bool)
            high[(keys[stay] >> np.uint64(48)).astype(np.int64)] = True
            tables[k] = (where, bits, keys[stay], ids[stay], shift[stay], high)
        if np.isin(self.sizes[items], self.exact).all():
            del self.tables[w]

    def _copies(self, items: np.ndarray, w: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Items with the most edits among other words, their items, and the number of their length in the class."""
        copies, owner, group = [], [], []
        sizes = np.minimum(self.sizes[items], LONG_ITEM)
        around = np.full(w - 1, self.oov)
        for g, size in enumerate(np.unique(sizes).tolist()):
            same = items[sizes == size]
            same = same[np.argsort(self.sizes[same], kind="stable")][:SIMULATED]
            for k in self.rng.permutation(np.resize(same, SIMULATED)).tolist():
                copies.append(np.concatenate([around, self._mutate(self.symbols[self.at[k] : self.at[k + 1]]), around]))
                owner.append(k)
                group.append(g)
        return copies, np.array(owner), np.array(group)

    def _pieces(self) -> list[tuple]:
        """Of the items searched exactly, by piece size: sorted keys of the pieces, their items and offsets, and a table of high bits."""
        at: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(np.isin(self.sizes, self.exact)).tolist():
            size = int(self.sizes[k])
            n = self.allowed(size) + 1
            at.setdefault(size // n, []).extend((k, i * size // n) for i in range(n))
        out = []
        for q, found in sorted(at.items()):
            item, offset = np.array(found).T
            keys = self._gram((self.at[item] + offset), self.symbols, q)
            order = np.argsort(keys, kind="stable")
            high = np.zeros(1 << 16, bool)
            high[(keys >> np.uint64(48)).astype(np.int64)] = True
            out.append((q, keys[order], item[order], offset[order], high))
        return out

    @staticmethod
    def _gram(start: np.ndarray, symbols: np.ndarray, q: int) -> np.ndarray:
        """Keys of the q symbols from each start."""
        key = np.zeros(len(start), np.uint64)
        for j in range(q):
            key = (key + symbols[start + j].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return mix(key)

    def _mutate(self, s: np.ndarray) -> np.ndarray:
        out = s.tolist()
        for _ in range(self.allowed(len(s))):
            kind, at = self.rng.integers(3), int(self.rng.integers(max(1, len(out))))
            if kind == 0 and out:
                out[at] = self.oov
            elif kind == 1:
                out.insert(at, self.oov)
            elif out:
                del out[at]
        return np.array(out, np.int64)

    def _keys(self, windows: np.ndarray, where: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Keys of windows given as rows of symbols."""
        n, w = windows.shape
        padded = np.concatenate([windows, np.full((n, 1), self.pad)], axis=1).ravel()
        return self._walk(padded, np.arange(n) * (w + 1), w, where, bits)

    def _walk(self, symbols: np.ndarray, start: np.ndarray, w: int, where: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The sampled symbols of the walks from ``start``, as keys; a pointer at the window's end writes padding."""
        key = np.zeros(len(start), np.uint64)
        at = start.astype(np.int32)
        end = start + w
        sampled = set(where.tolist())
        for j in range(int(where[-1]) + 1):
            s = symbols[at]
            if j >= w:
                s = np.where(at >= end, np.int32(self.pad), s)
            if j in sampled:
                key = (key + s.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            at += bits[j][s]
        return mix(key)

    def search(self, flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, word behind the last) of each item in each text: its best place."""
        hashes, at = word_hashes(flat, offsets)
        if not len(hashes) or not len(self.words):
            return []
        # texts are laid out with unknown words behind each
        words, at = np.diff(at), at + self.gap * np.arange(len(at))
        end = at[:-1] + words
        symbols = np.full(int(at[-1]) + 1, self.oov, np.int32)
        near = np.flatnonzero(self.high[(hashes >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.words, hashes[near]), len(self.words) - 1)
        symbols[ranges(at[:-1], words)[near]] = np.where(self.words[k] == hashes[near], k, self.oov)
        known = np.r_[0, np.cumsum(symbols[:-1] != self.oov)]
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        hits = []
        for w, tables in self.tables.items():
            if len(text) < w:
                continue
            start = np.arange(len(text) - w + 1)
            ok = (known[w:] - known[:-w] >= w - self.unknown[w]) & (text[: len(start)] == text[w - 1 :])
            start = start[ok].astype(np.int32)
            for a in range(0, len(start), 100_000):
                part = start[a : a + 100_000]
                for where, bits, keys, items, shift, high in tables:
                    key = self._walk(symbols, part, w, where, bits)
                    i = np.flatnonzero(high[(key >> np.uint64(48)).astype(np.int64)])
                    lo, hi = np.searchsorted(keys, key[i], "left"), np.searchsorted(keys, key[i], "right")
                    n = hi - lo
                    if n.any():
                        which = ranges(lo, n)
                        p = np.repeat(part[i], n)
                        hits.append(np.stack([text[p], items[which], p - shift[which]]))
        for q, keys, items, shift, high in self.pieces:
            if len(text) < q:
                continue
            start = np.flatnonzero((known[q:] - known[:-q] == q) & (text[: len(text) - q + 1] == text[q - 1 :]))
            key = self._gram(start, symbols, q)
            i = np.flatnonzero(high[(key >> np.uint64(48)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, key[i], "left"), np.searchsorted(keys, key[i], "right")
            which = ranges(lo, hi - lo)
            p, item = np.repeat(start[i], hi - lo), items[which]
            place, most = p - shift[which], (self.sizes[item] * self.edits).astype(np.int64)
            # a match at this place has all but its edits of the item's words within as many words of it
            a, b = np.maximum(place - most, at[text[p]]), np.minimum(place + self.sizes[item] + most, end[text[p]])
            ok = known[b] - known[a] >= self.sizes[item] - most
            hits.append(np.stack([text[p], item, place])[:, ok])
        if not hits:
            return []
        rows = np.unique(np.concatenate(hits, axis=1), axis=1).T.tolist()
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        reach = (-1, -1, 0)
        for t, item, place in rows:
            size = int(self.sizes[item])
            most = self.allowed(size)
            slack = 2 * most + 2
            if reach[:2] == (t, item) and place <= reach[2]:
                continue  # the last region holds this place
            lo, hi = max(int(at[t]), place - slack), min(int(end[t]), place + size + 2 * slack)
            reach = (t, item, place + slack)
            d, a, b = best_place(self.symbols[self.at[item] : self.at[item + 1]], symbols[lo:hi])
            if d <= most and d < out.get((t, item), (most + 1,))[0]:
                out[t, item] = (d, lo + a - int(at[t]), lo + b - int(at[t]))
        return [(t, item, *v) for (t, item), v in out.items()]


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance between the item and a stretch of the text, and that stretch (leftmost of the shortest reach)."""
    n = len(text)
    ramp = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), ramp.copy()
    big = 1 << 20
    for i, s in enumerate(item.tolist()):
        # cost times big plus the stretch's length: ties go to the shortest
        diagonal = row[:-1] + (text != s)
        up = row + 1
        cost = up.copy()
        own = start.copy()
        better = diagonal <= up[1:]
        cost[1:] = np.where(better, diagonal, up[1:])
        own[1:] = np.where(better, start[:-1], start[1:])
        cost[0] = i + 1
        # gaps in the item: cost[j] may come from any earlier cell, one a word
        slid = cost - ramp
        least = np.minimum.accumulate(slid)
        come = np.maximum.accumulate(np.where(slid == least, ramp, -1))
        row, start = least + ramp, own[come]
    width = ramp - start
    j = int(np.argmin(row * big + width))
    return int(row[j]), int(start[j]), j


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """(id, item, n_words, edits, start, end): items of which a document has a stretch within ``edits`` times the item's words.

    One row for each row of ``docs`` and item, with the best stretch as word
    positions from 0. Null and empty texts and items match nothing; repeated and
    null ids are taken row by row; other columns aren't read; empty tables give no
    rows. The benchmark is the query set: its size is measured first, and it is
    broadcast in blocks of at most ``BLOCK_BYTES`` of text (a single item may be
    longer). No shuffle.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField(item_col, item_type), *(T.StructField(c, T.LongType(), False) for c in ("n_words", "edits", "start", "end"))])
    found = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("text", "item").toArrow()
        part = _search(docs.select(id_col, text_col), _shared_index(docs.sparkSession, part, edits, recall), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _shared_index(spark: SparkSession, part: pa.Table, edits: float, recall: float) -> Broadcast:
    """The index of a block of items, broadcast; the driver keeps none of the memory that building took."""
    shared = spark.sparkContext.broadcast(Index(part["item"].to_pylist(), part["text"].to_pylist(), edits, recall))
    trim()
    return shared


def _search(docs: DataFrame, shared: Broadcast, schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in tidy(batches):
            flat, offsets = flat_text(batch.column(1))
            for a, b in steps(offsets):
                found = ix.search(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if found:
                    t, item, d, start, end = (list(c) for c in zip(*found, strict=True))
                    ids = batch.column(0).take(pa.array([a + i for i in t]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([ix.ids[i] for i in item], arrow.field(1).type), pa.array([int(ix.sizes[i]) for i in item]), pa.array(d), pa.array(start), pa.array(end)], schema=arrow)

    return docs.mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns unchanged; null texts stay."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    at, schema = docs.columns.index(text_col), docs.schema
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("text", "item").toArrow()
        shared = _shared_index(docs.sparkSession, part, edits, recall)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in tidy(batches):
                flat, offsets = flat_text(batch.column(at))
                keep = np.ones(len(batch), bool)
                for a, b in steps(offsets):
                    for t, *_ in shared.value.search(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        keep[a + t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
