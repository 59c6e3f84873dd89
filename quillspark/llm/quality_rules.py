"""Quality rules whose cutoffs come from mergeable quantile sketches.

Fixed base rules reject very short and very repetitive texts. Every other cutoff
adapts to the corpus: each (language, source) has a histogram sketch of each
measure with buckets of at most 1/16 relative width (exact below 32). Sketches
merge by adding bucket counts, so a source with few documents takes the merged
sketch of its language, and a language with few the one of the whole corpus. A
document goes if a measure lies beyond the far fence: upper quartile plus
``SPREAD`` times the quartile distance, which counts as at least the measure's
``floor``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import flat_text, free_prefix, steps, stored, tidy

#: A sketch stands for its own group from so many documents on.
LEAST_DOCS = 200
SPREAD = 6
#: Smallest quartile distance of each measure (measures: thousandths; word length: hundredths of a character).
FLOORS = {"symbols": 10, "dup_lines": 60, "repeats": 70, "upper": 20, "word_length": 20}
MIN_WORDS = 50
#: Cutoff tables up to this many rows are broadcast (a row has two strings and ten numbers); larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
UPPER = re.compile("[^A-ZÀ-ÖØ-Þ]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """Words in three-word windows that a text has twice or more."""
    code: defaultdict[bytes, int] = defaultdict()
    code.default_factory = code.__len__
    codes = np.array([code[w] for doc in words for w in doc], np.int64)
    sizes = np.array([len(d) for d in words], np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    if len(codes) < 3:
        return np.zeros(len(words), np.int64)
    k = np.int64(len(code))
    _, two = np.unique(codes[:-1] * k + codes[1:], return_inverse=True)
    inside = doc[:-2] == doc[2:]
    three = two[:-1][inside] * k + codes[2:][inside]
    _, three = np.unique(three, return_inverse=True)
    _, back, times = np.unique(three * len(words) + doc[:-2][inside], return_inverse=True, return_counts=True)
    start = np.flatnonzero(inside)[times[back] > 1]
    covered = np.zeros(len(codes), bool)
    for d in range(3):
        covered[start + d] = True
    return np.bincount(doc[covered], minlength=len(words))


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of each text; null counts as empty."""
    rows = []
    words = []
    for text in texts:
        text = text or ""
        raw = text.encode()
        own = raw.split()
        words.append(own)
        lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
        chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
        rows.append((len(own), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines), len(UPPER.sub("", text))))
    out = np.array(rows, np.int64).reshape(-1, len(COUNTS))
    out[:, 4] = _repeat_words(words)
    return dict(zip(COUNTS, out.T, strict=True))


def with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the counts of ``COUNTS``, named ``_q_...``."""
    schema = T.StructType([*docs.schema, *(T.StructField(f"_q_{c}", T.LongType(), False) for c in COUNTS)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            _, offsets = flat_text(batch.column(at))
            for a, b in steps(offsets):
                part = batch.slice(a, b - a)
                counts = measure(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v) for v in counts.values())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _share(part: str, whole: str, times: int = 1000):
    return F.coalesce(F.expr(f"(_q_{part} * {times}L) div nullif(_q_{whole}, 0)"), F.lit(0).cast("long"))


def _measures(df: DataFrame) -> DataFrame:
    words, again = F.col("_q_n_words"), F.col("_q_n_repeat_words")
    return df.withColumns(
        {
            "_q_base_failed": (words < MIN_WORDS) | (again * 100 > words * 50),
            "_q_symbols": _share("n_symbols", "word_chars"),
            "_q_dup_lines": _share("n_dup_lines", "n_lines"),
            "_q_repeats": _share("n_repeat_words", "n_words"),
            "_q_upper": _share("n_upper", "word_chars"),
            "_q_word_length": _share("word_chars", "n_words", 100),
        }
    )


def _bucket(v):
    e = F.length(F.bin(v)).cast("long") - 5
    return F.when(v < 32, v).otherwise(e * 16 + F.call_function("shiftright", v, e.cast("int")))


def _lower_edge(b):
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", b % 16 + 16, (F.floor(b / 16) - 1).cast("int")).cast("long"))


def sketches(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable histograms, without documents that fail the base rules."""
    named = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), _bucket(F.col(f"_q_{m}")).alias("bucket")) for m in FLOORS))).alias("x")
    rows = _measures(counted).where("not _q_base_failed").select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), named)
    return rows.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """(lang, source, then ``low_m`` and ``high_m`` of each measure m) for every group of the sketches."""
    sets = sketch.cube("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"), F.grouping_id("lang", "source", "measure", "bucket").alias("g"))
    # own groups, languages, the whole corpus
    sets = sets.where(F.col("g").isin(0, 4, 12))
    fences = _fences(sets)
    own = fences.where("g = 0")
    lang = fences.where("g = 4").select("lang", "measure", *(F.col(c).alias(f"lang_{c}") for c in ("docs", "low", "high")))
    whole = fences.where("g = 12").select("measure", *(F.col(c).alias(f"all_{c}") for c in ("low", "high")))
    pick = {c: F.when(F.col("docs") >= LEAST_DOCS, F.col(c)).when(F.col("lang_docs") >= LEAST_DOCS, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}")) for c in ("low", "high")}
    rows = own.join(lang, ["lang", "measure"]).join(whole, "measure").select("lang", "source", "measure", *(v.alias(k) for k, v in pick.items()))
    return rows.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for m in FLOORS for c in ("low", "high")))


def _fences(sets: DataFrame) -> DataFrame:
    keys = ("g", "lang", "source", "measure")
    # a group has at most about a thousand buckets, whatever its documents
    filled = sets.groupBy(*keys).agg(F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("h"))

    def quartile(k: int):
        step = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("b")), lambda s, x: F.struct((s.n + x.n).alias("n"), F.when((s.b < 0) & ((s.n + x.n) * 4 >= F.col("docs") * k), x.bucket).otherwise(s.b).alias("b")))
        return _lower_edge(step.b)

    out = filled.withColumns({"q1": quartile(1), "q3": quartile(3)})
    floor = F.coalesce(*(F.when(F.col("measure") == m, F.lit(v).cast("long")) for m, v in FLOORS.items()))
    spread = F.greatest(F.col("q3") - F.col("q1"), floor) * SPREAD
    return out.select(*keys, "docs", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def judged(counted: DataFrame, cuts: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``counted`` with ``_q_base_failed`` and ``_q_kept``, by a join with the cutoffs of its language and source."""
    cuts = cuts.withColumnsRenamed({c: f"_q_{c}" for c in cuts.columns})
    n = cuts.limit(BROADCAST_ROWS + 1).count()
    if n <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    rows = _measures(counted).withColumns({"_q_l": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "_q_s": F.coalesce(F.col(source_col).cast("string"), F.lit(""))})
    out = rows.join(cuts, (F.col("_q_l") == F.col("_q_lang")) & (F.col("_q_s") == F.col("_q_source")), "left")
    odd = F.lit(False)
    for m in FLOORS:
        odd = odd | F.coalesce(F.col(f"_q_{m}") > F.col(f"_q_high_{m}"), F.lit(False))
    odd = odd | F.coalesce(F.col("_q_word_length") < F.col("_q_low_word_length"), F.lit(False))
    return out.withColumn("_q_kept", ~F.col("_q_base_failed") & ~odd)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row of counts and verdict for each row of ``docs``.

    Null texts count as empty, null languages and sources as the empty string;
    null and repeated ids are judged row by row; an empty table gives none.
    Counts are written once to the shared folder and serve both the sketches and
    the verdicts. A table where no document passes the base rules has no cutoffs.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    counted = stored(with_counts(rows, "text").drop("text"), "quality")
    cuts = stored(cutoffs(sketches(counted)), "cutoffs")
    out = judged(counted, cuts)
    return out.select(F.col("id").alias(id_col), *(F.col(f"_q_{c}").alias(c) for c in COUNTS), F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged, also those named like the operator's own (``_q_``). Two scans, no shuffle of texts."""
    own = free_prefix(docs.drop(text_col, lang_col, source_col), "_q_")
    if own != "_q_":
        aside = {c: f"{own[:-3]}kept_{k}" for k, c in enumerate(docs.columns) if c.lower().startswith("_q_")}
        kept = quality_filter(docs.withColumnsRenamed(aside), aside.get(text_col, text_col), aside.get(lang_col, lang_col), aside.get(source_col, source_col))
        return kept.withColumnsRenamed({v: k for k, v in aside.items()})
    counted = with_counts(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), "text").drop("text")
    cuts = stored(cutoffs(sketches(counted)), "cutoffs")
    return judged(with_counts(docs, text_col), cuts, lang_col, source_col).where("_q_kept").select(*(F.col(f"`{c}`") for c in docs.columns))
