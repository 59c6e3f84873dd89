"""Maximal periodic runs of words, found as branching tandem repeats in a suffix tree.

After Stoye and Gusfield. The words of each text, closed by an end mark of its own,
are sorted as suffixes; suffix order and common prefixes give the suffix tree, whose
nodes are intervals of the order with a depth in words.

1. At each inner node of depth D the leaves of all children but the largest are
   walked. Where i is such a leaf and i + D (or i - D) is a leaf of the node as
   well, D words at the smaller place stand twice in a row; if the word behind the
   pair isn't the pair's first, the repeat branches. Each leaf is walked at most
   log2(n) times, as its list at least doubles.
2. A branching repeat is rotated to the left while the word in front equals the one
   a period later; all rotations together are the longest stretch of that period.
3. Stretches with the same bounds are one run, whose period is the smallest.

All steps are numpy over the texts of a batch at once: the sort doubles the prefix it
compares and drops suffixes that are alone, the ranks of each doubling are kept and
answer how far two places agree in either direction, and the bounds of nodes come
from a table of minima over powers of two. A text lies in one task, and texts don't
meet, so nothing is shuffled; memory grows with the longest text (some 40 bytes for
each of its words, and 4 for each doubling that its longest repeat takes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import flat_text, ranges, steps, tidy
from .packed_words import packed_words

#: Fewest words and fewest periods of a run.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Bytes of text that one tree holds; a longer text has one to itself.
STEP_TEXT = 1 << 20
#: Leaves that one step walks.
STEP_LEAVES = 1 << 19


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, levels): suffixes in order, and ranks by their first 1, 2, 4, ... symbols; the last ranks are all different.

    The last symbol must stand nowhere else.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    slots = np.arange(n)
    first = np.maximum.accumulate(np.where(np.r_[True, sorted_[1:] != sorted_[:-1]], slots, 0))
    rank = np.empty(n, np.int32)
    rank[order] = first
    levels, h = [rank], 1
    while True:
        # a slot is open as long as its neighbour has its rank
        same = first[1:] == first[:-1]
        stay = np.r_[same, False] | np.r_[False, same]
        slots, first = slots[stay], first[stay]
        if not len(slots):
            return order, levels
        key = first * np.int64(n) + rank[order[slots] + h]
        by = np.argsort(key, kind="stable")
        order[slots] = order[slots[by]]
        key = key[by]
        first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], slots, 0))
        rank = rank.copy()
        rank[order[slots]] = first
        levels.append(rank)
        h *= 2


def common_ahead(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from a and from b on agree; a and b differ."""
    top = np.full(len(a), -1, np.int64)
    live = np.arange(len(a))
    for k, rank in enumerate(levels):
        live = live[rank[a[live]] == rank[b[live]]]
        if not len(live):
            break
        top[live] = k
    out = np.where(top >= 0, 1 << np.maximum(top, 0), 0)
    for k in range(int(top.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(top > k)
        live = live[levels[k][a[live] + out[live]] == levels[k][b[live] + out[live]]]
        out[live] += 1 << k
    return out


def common_behind(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols in front of a and of b agree; a < b."""
    out = np.zeros(len(a), np.int64)
    for k in [*range(len(levels)), *range(len(levels) - 1, -1, -1)]:
        at = a - out - (1 << k)
        ok = np.flatnonzero(at >= 0)
        ok = ok[levels[k][at[ok]] == levels[k][at[ok] + (b - a)[ok]]]
        out[ok] += 1 << k
    return out


def _bounds(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last one before and the first one after with a smaller value (else the end)."""
    n, value = len(lcp), lcp[at]
    widest = int(np.diff(np.flatnonzero(np.r_[lcp == 0, True])).max(initial=1))
    least = [lcp]
    while 1 << len(least) <= widest:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][: n - 2 * half + 1], least[-1][half : n - half + 1]))
    left, right = at.copy(), at + 1
    for k in range(len(least) - 1, -1, -1):
        step = 1 << k
        ok = np.flatnonzero(left >= step)
        ok = ok[least[k][left[ok] - step] >= value[ok]]
        left[ok] -= step
        ok = np.flatnonzero(right + step <= n)
        ok = ok[least[k][right[ok]] >= value[ok]]
        right[ok] += step
    return left - 1, right


def inner_nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smaller children of all inner nodes but the roots: (first slot, number of leaves, depth, and the slots of the node, from and to).

    ``lcp[s]`` is how far the suffixes in slots s - 1 and s agree.
    """
    at = np.flatnonzero(lcp > 0)
    left, right = _bounds(lcp, at)
    by = np.argsort(left * np.int64(len(lcp) + 1) + right, kind="stable")
    at, left, right = at[by], left[by], right[by]
    new = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])][: len(at)]
    head = np.flatnonzero(new)  # first inner bound of each node; bounds of a node ascend
    node = np.cumsum(new) - 1
    start = np.concatenate([left[head], at])  # a child starts at the node's start or at one of its bounds
    of = np.concatenate([np.arange(len(head)), node])
    by = np.lexsort((start, of))
    start, of = start[by], of[by]
    last = np.r_[of[1:] != of[:-1], True][: len(of)]
    size = np.where(last, right[head][of], np.r_[start[1:], 0][: len(of)]) - start
    best = np.maximum.reduceat(size, np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])) if len(of) else size
    largest = np.flatnonzero(size == best[of]) if len(of) else np.zeros(0, np.int64)
    largest = largest[np.r_[True, of[largest[1:]] != of[largest[:-1]]][: len(largest)]]  # one a node
    small = np.ones(len(of), bool)
    small[largest] = False
    head = head[of[small]]
    return start[small], size[small], lcp[at[head]].astype(np.int64), left[head], right[head]


def branching_repeats(symbols: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all branching tandem repeats."""
    slot = levels[-1]
    lcp = np.r_[0, common_ahead(levels, order[:-1], order[1:])].astype(np.int32)
    start, size, depth, low, high = inner_nodes(lcp)
    places, periods = [], []
    ends = np.cumsum(size)
    for a, b in steps(np.r_[0, ends], STEP_LEAVES):
        leaf = order[ranges(start[a:b], size[a:b])]
        d, lo, hi = (np.repeat(x[a:b], size[a:b]) for x in (depth, low, high))
        for at in (leaf, leaf - d):
            ok = np.flatnonzero(at >= 0)
            other = slot[(at if at is not leaf else leaf + d)[ok]]
            ok = ok[(other >= lo[ok]) & (other < hi[ok])]
            i, p = at[ok], d[ok]
            ok = symbols[i] != symbols[i + 2 * p]
            places.append(i[ok])
            periods.append(p[ok])
    i, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, periods))
    keep = np.unique(i * np.int64(len(symbols) + 1) + p, return_index=True)[1]
    return i[keep], p[keep]


def maximal_runs(codes: np.ndarray, count: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of each text, by start and period; ``codes`` are its words as numbers, ``count`` how many each has."""
    if periods < 2:
        raise ValueError("a run has two periods at least")
    texts = len(count)
    own = np.repeat(np.arange(texts), count)
    span = int(codes.max(initial=0)) + 2
    first = np.cumsum(count + 1) - count - 1  # of each text, with an end mark behind each
    symbols = np.empty(len(codes) + texts, np.int64)
    symbols[np.arange(len(codes)) + own] = own * span + codes
    symbols[first + count] = np.arange(texts) * span + span - 1
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 4
    order, levels = suffix_order(symbols)
    i, p = branching_repeats(symbols, order, levels)
    start = i - common_behind(levels, i, i + p)
    end = i + 2 * p
    long = end - start >= np.maximum(least, periods * p)
    start, end, p = start[long], end[long], p[long]
    by = np.lexsort((p, end, start))
    start, end, p = start[by], end[by], p[by]
    keep = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(by)]
    start, end, p = start[keep], end[keep], p[keep]
    by = np.lexsort((p, start))
    start, end, p = start[by], end[by], p[by]
    text = np.searchsorted(first, start, "right") - 1
    return text, start - first[text], end - start, p


def _collapsed(data: np.ndarray, at: np.ndarray, count: np.ndarray, runs: tuple[np.ndarray, ...]) -> pa.Array:
    """Each text's words with one space between them, without what its runs repeat."""
    text, start, length, period = runs
    first = np.r_[0, np.cumsum(count)]
    cover = np.zeros(len(at), np.int64)
    np.add.at(cover, first[text] + start + period, 1)
    np.add.at(cover, first[text] + start + length, -1)
    keep = np.cumsum(cover)[:-1] == 0
    size = np.where(keep, np.diff(at), 0)
    total = np.r_[0, np.cumsum(size)][first]
    data = data[np.repeat(keep, np.diff(at))]
    some = np.diff(total) > 0  # their last space goes
    use = np.ones(len(data), bool)
    use[total[1:][some] - 1] = False
    cuts = total - np.r_[0, np.cumsum(some)]
    return pa.Array.from_buffers(pa.large_string(), len(count), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[use]))])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """(id, n_words, runs, collapsed) for each row of ``docs``.

    A word is a run of characters other than the space and 9 to 13. ``runs`` has
    (start, length, period), by start and then period: stretches of at least
    ``least`` words and ``periods`` of their smallest period that no neighbour
    extends; places are word numbers from 0. ``collapsed`` has the words with one
    space between them, without those that a run holds behind its first period.

    Null and empty texts, and those without words, have no runs and an empty
    ``collapsed``. Null and repeated ids are rows like others, equal texts give
    equal rows; other columns aren't read, whatever their names; an empty table
    gives none. Invalid bytes count as characters.
    """
    whole = T.LongType()
    runs_type = T.ArrayType(T.StructType([T.StructField(c, whole, False) for c in ("start", "length", "period")]), False)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", whole, False), T.StructField("runs", runs_type, False), T.StructField("collapsed", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            flat, offsets = flat_text(batch.column(1))
            for a, b in steps(offsets, STEP_TEXT):
                data, at, count = packed_words(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
                found = maximal_runs(words.dictionary_encode().indices.to_numpy(), count, least, periods)
                values = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in found[1:]], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[0], np.arange(b - a + 1)), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count), lists, _collapsed(data, at, count, found).cast(pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
