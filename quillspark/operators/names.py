"""Many names looked up in texts at once, by an Aho-Corasick automaton instead of a join by patterns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of names that one automaton holds; more names make more automata, and a pass over the texts for each.
BLOCK_BYTES = 4 << 20

#: Alternatives that are literals between word bounds, as lexicons of aliases have them.
LITERALS = r"(?s)^\\b(?:[^\\|()\[\]{}.*+?^$]|\\[^A-Za-z0-9])+\\b(?:\|\\b(?:[^\\|()\[\]{}.*+?^$]|\\[^A-Za-z0-9])+\\b)*$"


class _Fold(dict):
    """Letter case as patterns ignore it: one letter for one letter."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        up = c.upper() if len(c.upper()) == 1 else c
        self[code] = ord(up.lower() if len(up.lower()) == 1 else up)
        return self[code]


_fold = _Fold()
_word: dict[str, bool] = {}
_made: dict[int, object] = {}


def _is_word(c: str) -> bool:
    known = _word.get(c)
    if known is None:
        kind = unicodedata.category(c)
        known = _word[c] = kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "\u200c\u200d"
    return known


def _automaton(shared, fold: bool):
    """The automaton of a broadcast list of (key, name), kept by the worker until another is asked for."""
    import ahocorasick

    if shared.value is not _made.get("of"):
        made = ahocorasick.Automaton()
        for key, name in shared.value:
            name = name.translate(_fold) if fold else name
            _, keys = made.get(name, (0, None)) or (0, None)
            made.add_word(name, (len(name), [*(keys or ()), key]))
        made.make_automaton()
        _made.clear()
        _made.update(of=shared.value, automaton=made)
    return _made["automaton"]


def _is_ascii_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _bounded(text: str, start: int, end: int, is_word=_is_word) -> bool:
    """Whether a word begins or ends at both edges."""
    before = start > 0 and is_word(text[start - 1])
    after = end < len(text) and is_word(text[end])
    return before != is_word(text[start]) and after != is_word(text[end - 1])


def _keys_of(automaton, text: str | None, whole_words: bool, fold: bool, is_word) -> set[str]:
    """The keys of the names that a text holds."""
    found: set[str] = set()
    for last, (n, own) in automaton.iter(text.translate(_fold) if fold else text) if text else ():
        if not found.issuperset(own) and (not whole_words or _bounded(text, last - n + 1, last + 1, is_word)):
            found.update(own)
    return found


def _blocks(spark: SparkSession, names: DataFrame) -> list[Broadcast]:
    """Broadcast lists of (key, name), each of about ``BLOCK_BYTES``, however many names there are."""
    ship(spark)
    names = names.where("name <> ''").select(F.col("key").cast("string").alias("key"), "name").distinct()
    total = names.agg(F.sum(F.octet_length("name") + F.octet_length("key"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    share = lambda k: names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k) if blocks > 1 else names
    return [spark.sparkContext.broadcast([(r["key"], r["name"]) for r in share(k).collect()]) for k in range(blocks)]


def find_keys(texts: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """All rows of ``texts`` with ``keys``, those of the names between word bounds that ``column`` holds, letter case ignored; a pass over the texts for each block of names, no shuffle."""
    out = texts.withColumn("keys", F.array().cast("array<string>"))
    at, kept = texts.columns.index(column), [*texts.columns, "keys"]
    for shared in _blocks(texts.sparkSession, names):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared, True)
            for batch in batches:
                keys = [sorted({*known, *_keys_of(automaton, text, True, True, _is_word)}) for known, text in zip(batch.column(len(kept) - 1).to_pylist(), batch.column(at).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.list_(pa.string()))], names=kept)

        out = out.mapInArrow(run, out.schema)
    return out


def find_names(texts: DataFrame, names: DataFrame, column: str, whole_words: bool = True, fold: bool = True, ascii_words: bool = False) -> DataFrame:
    """The rows of ``texts`` with the ``key`` of each name in ``names(key, name)`` that ``column`` holds, one row a key.

    ``fold`` ignores letter case; ``whole_words`` asks for a word bound at both edges
    of a name, as ``\\b`` does; with ``ascii_words`` only ASCII letters, digits and the underscore make words. Names are dealt to blocks of bounded bytes, whose automata
    go over each text once. Null texts and empty or null names have no hits.
    """
    spark = texts.sparkSession
    if "key" in texts.columns:
        raise ValueError("texts have a column key of their own")
    shares = _blocks(spark, names)
    blocks = len(shares)
    kept = texts.schema
    is_word = _is_ascii_word if ascii_words else _is_word
    at = kept.names.index(column)
    out = spark.createDataFrame([], kept).withColumn("key", F.lit(None).cast("string"))
    for shared in shares:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared, fold)
            for batch in batches:
                rows, keys = [], []
                for i, text in enumerate(batch.column(at).to_pylist()):
                    found = _keys_of(automaton, text, whole_words, fold, is_word)
                    rows += [i] * len(found)
                    keys += sorted(found)
                part = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.string())], names=[*kept.names, "key"])

        out = out.union(texts.mapInArrow(run, out.schema))
    return out.distinct() if blocks > 1 else out


def literal_names(pattern: Column) -> Column:
    """The names of a pattern that is made of ``LITERALS``; null for others."""
    parts = F.transform(F.split(pattern, r"(?<=\\b)\|"), lambda p: F.regexp_replace(F.substring(p, F.lit(3), F.length(p) - 4), r"(?s)\\(.)", "$1"))
    return F.when(pattern.rlike(LITERALS), parts)
