"""Registered queries of this subpackage: thin callers of its operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import shared_dir, stored
from .license_scan import oracle_sql as license_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers that are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_decode

    out = encode_decode(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_report

    out = quality_report(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Texts of a query's oracle: words, lines and windows are taken apart, and the sketches merged, as the operator's docstring says.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
t AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM t) WHERE c > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
      len(l) AS n_lines, length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper FROM d LEFT JOIN r USING (doc_id)),
m AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS symbols,
      coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS dup_lines, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeats,
      coalesce(n_upper * 1000 // nullif(word_chars, 0), 0) AS upper, coalesce(word_chars * 100 // nullif(n_words, 0), 0) AS word_length FROM c),
u AS (SELECT lang, source, unnest([{'m': 'symbols', 'v': symbols}, {'m': 'dup_lines', 'v': dup_lines}, {'m': 'repeats', 'v': repeats}, {'m': 'upper', 'v': upper}, {'m': 'word_length', 'v': word_length}]) AS x FROM m WHERE NOT base_failed),
b AS (SELECT lang, source, x.m AS m, CASE WHEN x.v < 32 THEN x.v ELSE (length(bin(x.v)) - 5) * 16 + (x.v >> (length(bin(x.v)) - 5)::INT) END AS b, count(*) AS n FROM u GROUP BY ALL),
s AS (SELECT 0 AS g, lang, source, m, b, n FROM b UNION ALL SELECT 1, lang, NULL, m, b, sum(n) FROM b GROUP BY lang, m, b UNION ALL SELECT 2, NULL, NULL, m, b, sum(n) FROM b GROUP BY m, b),
k AS (SELECT *, sum(n) OVER (PARTITION BY g, lang, source, m ORDER BY b) AS up, sum(n) OVER (PARTITION BY g, lang, source, m) AS docs FROM s),
q AS (SELECT g, lang, source, m, max(docs) AS docs, min(b) FILTER (up * 4 >= docs) AS b1, min(b) FILTER (up * 4 >= docs * 3) AS b3 FROM k GROUP BY ALL),
e AS (SELECT *, CASE WHEN b1 < 32 THEN b1 ELSE (b1 % 16 + 16) << (b1 // 16 - 1)::INT END AS q1, CASE WHEN b3 < 32 THEN b3 ELSE (b3 % 16 + 16) << (b3 // 16 - 1)::INT END AS q3,
      CASE m WHEN 'symbols' THEN 10 WHEN 'dup_lines' THEN 60 WHEN 'repeats' THEN 70 ELSE 20 END AS f FROM q),
f AS (SELECT g, lang, source, m, docs, q1 - 6 * greatest(q3 - q1, f) AS low, q3 + 6 * greatest(q3 - q1, f) AS high FROM e),
p AS (SELECT o.lang, o.source, o.m, CASE WHEN o.docs >= 200 THEN o.low WHEN l.docs >= 200 THEN l.low ELSE a.low END AS low, CASE WHEN o.docs >= 200 THEN o.high WHEN l.docs >= 200 THEN l.high ELSE a.high END AS high
      FROM f o JOIN f l ON o.g = 0 AND l.g = 1 AND o.lang = l.lang AND o.m = l.m JOIN f a ON a.g = 2 AND a.m = o.m),
x AS (SELECT lang, source, max(high) FILTER (m = 'symbols') AS hs, max(high) FILTER (m = 'dup_lines') AS hd, max(high) FILTER (m = 'repeats') AS hr, max(high) FILTER (m = 'upper') AS hu, max(high) FILTER (m = 'word_length') AS hw, max(low) FILTER (m = 'word_length') AS lw FROM p GROUP BY ALL)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(symbols > hs, FALSE) AND NOT coalesce(dup_lines > hd, FALSE) AND NOT coalesce(repeats > hr, FALSE) AND NOT coalesce(upper > hu, FALSE) AND NOT coalesce(word_length > hw OR word_length < lw, FALSE) AS kept
FROM m LEFT JOIN x USING (lang, source)
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import dictionary, find_secrets, labelled_findings, train_forest

    docs = _table(spark, sf_dir, "documents")
    words = dictionary(docs)
    found = find_secrets(docs, train_forest(labelled_findings(spark), words), words=words)
    return found.withColumn("value_sha256", F.sha2(F.col("value").cast("binary"), 256)).drop("value")


def op5_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .window_dedup import repeated_windows, text_key

    docs = _table(spark, sf_dir, "documents")
    cut = repeated_windows(docs).select(  # a row a text; written, so that a join skewed by copies can be split
        "k0",
        "k1",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    cut = stored(cut, "cut")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = docs.select("doc_id", *text_key(F.col("text")), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("own"))
    none = F.lit(0).cast("long")
    return own.join(cut, ["k0", "k1"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .record_files import checksums, read_token_files, write_token_files

    out = f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    manifest = write_token_files(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), out)
    return checksums(read_token_files(spark, manifest)).withColumnRenamed("id", "doc_id")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("templates")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth text by the checksum of its id repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    chosen = chosen.withColumn("_n", F.coalesce(F.size("_w"), F.lit(0)).cast("long")).withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")))
    rest = F.col("_n") - F.col("_a")
    period = F.lit(1) + F.floor(rest / (F.lit(3) + g % 8))
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a").cast("int") + 1, period.cast("int")), F.ceil(rest / period).cast("int")))
    words = F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), again), F.lit(1), F.col("_n").cast("int"))
    return chosen.select("doc_id", F.when(F.col("_n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in ``documents``, a tenth of which get one planted."""
    from .periodic_runs import find_runs

    found = find_runs(_with_planted_runs(_table(spark, sf_dir, "documents")))
    # runs come by start and period, so the first of the longest in periods stays
    longer = lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best)  # noqa: E731
    best = F.aggregate("runs", F.get("runs", F.lit(0)), longer)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: The checksum of an id goes by its definition, bit by bit. Words that are equal at a distance q
#: make stretches; those with the same bounds are one run, of the smallest distance.
OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT range AS v, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)]))) AS h FROM documents, crc),
raw AS (SELECT doc_id, h, h // 10 AS g, w, len(w) AS n FROM (SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents JOIN ids USING (doc_id))),
cut AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM raw WHERE h % 10 = 0 AND n > 0),
d AS (SELECT doc_id, n, w FROM raw WHERE h % 10 <> 0 OR n = 0
  UNION ALL SELECT doc_id, n, list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END) FROM cut),
words AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM d),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, s AS start, e - s AS length, min(q) AS period FROM islands WHERE e - s >= greatest(24, 3 * q) GROUP BY doc_id, s, e),
best AS (SELECT doc_id, start, length, period FROM (SELECT r.*, EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period
         OR (o.length * r.period = r.length * o.period AND (o.start < r.start OR (o.start = r.start AND o.period < r.period))))) AS beaten FROM runs r) WHERE NOT beaten),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and their components."""
    from .simhash_join import near_simhashes

    return near_simhashes(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_secrets": op4_secrets,
    "op5_windows": op5_windows,
    "op6_html_text": op6_html_text,
    "op7_token_counts": op7_token_counts,
    "op8_records": op8_records,
    "op9_licenses": op9_licenses,
    "op10_jaccard": op10_jaccard,
    "op11_runs": op11_runs,
    "op12_simhash": op12_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality": OP2_SQL,
    "op9_licenses": license_sql(),
    "op11_runs": OP11_SQL,
}
