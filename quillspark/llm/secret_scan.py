"""Secret scans whose false positives a random forest removes, in DataFrame functions only.

Candidates are values assigned to names such as token or password, and long runs of
key characters. A forest that Spark ML trains on labelled findings is turned
into a column expression over features of each candidate: its length, the
transitions between and inside character classes, how much of it dictionary words
cover, whether it looks like a path, and the words beside it. The dictionary is the
corpus's own: its most frequent words, counted over all texts. Findings are cut
from text by the scanner itself, in training too. Scanning works row by row inside
Spark's own expressions: no shuffle, no Python on executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, free_prefix

NAMES = ("password", "passwd", "pwd", "secret", "token", "api_?key", "access_?key", "auth")
#: What every name above holds, for a test that costs less than a pattern.
STEMS = ("pass", "pwd", "secret", "token", "key", "auth")
KEY = "A-Za-z0-9_+/-"
ASSIGNED = rf"[A-Za-z0-9_-]*(?i:{'|'.join(NAMES)})[A-Za-z0-9_-]*[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
#: A run of key characters with padding, or three of them between dots, taken where it starts.
RUN = rf"(?<![{KEY}])(?:eyJ[{KEY}]+\.[{KEY}]+\.[{KEY}]+|[{KEY}]{{16,}}={{0,2}})"
CANDIDATE = rf"(?<![{KEY}]){ASSIGNED}[^\s\"']{{6,}}|{RUN}"
LEFT, RIGHT = 60, 30
THRESHOLD = 0.5
REDACTED = "[REDACTED]"

# Prefixes of well-known key kinds.
KINDS = (("aws", "^(AKIA|ASIA)[A-Z0-9]{16}$"), ("github", "^gh[pousr]_[A-Za-z0-9]{30,}$"), ("slack", "^xox[abprs]-"), ("stripe", "^sk_(live|test)_"), ("google", "^AIza[A-Za-z0-9_-]{30,}$"), ("jwt", "^eyJ[A-Za-z0-9_-]{10,}"))
# Word parts that stand in identifiers and generated findings, and frequent letter pairs.
PARTS = "the|and|ing|tion|ent|ion|for|tha|ere|ate|ver|der|sch|und|ein|ich|che|den|ung|que|les|ment|des|est|eau|con|ado|aci|par|com|pro|able|ness|key|user|data|test|file|page|path|home|name|http|www|html|image|index|main|config|version"
PAIRS = "th|he|in|er|an|re|on|en|at|nd|st|es|or|te|of|ed|is|it|al|ar|ou|ea|ch|ei|de|le|ti"
#: Words of the corpus that join the parts in the dictionary.
DICTIONARY_WORDS = 200

FEATURES = ("length", "digits", "upper", "marks", "classes", "pairs", "vowels", "covered", "distinct", "hex", "number", "named", "assigned", "hashed", "path", "sample", "known")


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of three to twelve letters, lowered, over all texts; ties by the word. Counts are pre-aggregated, and ``most`` rows reach the driver."""
    word = F.explode(F.split(F.lower(F.col(f"`{text_col}`")), r"[^\p{L}]+")).alias("word")
    counted = docs.select(word).where(F.length("word").between(3, 12)).groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def features(value: Column, left: Column, right: Column, words: list[str] = ()) -> dict[str, Column]:
    """The forest's features of a candidate, as doubles; ``words`` join the fixed parts in the dictionary."""
    n = F.greatest(F.length(value), F.lit(1))
    count = lambda pattern: F.regexp_count(value, F.lit(pattern))
    lower = F.lower(value)
    flag = lambda c: c.cast("double")
    known = "|".join(map(re.escape, sorted({*PARTS.split("|"), *words}, key=lambda w: (-len(w), w))))
    cols = {
        "length": n.cast("double"),
        "digits": count("[0-9]") / n,
        "upper": count("[A-Z]") / n,
        "marks": count("[^A-Za-z0-9]") / n,
        "classes": count("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]") / n,
        "pairs": F.regexp_count(lower, F.lit(f"(?={PAIRS})")) / n,
        "vowels": F.regexp_count(lower, F.lit("[aeiou]")) / n,
        "covered": (n - F.length(F.regexp_replace(lower, known, ""))) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex": flag(value.rlike("^[0-9a-fA-F]+$")),
        "number": flag(value.rlike("^[0-9-]+$")),
        "named": flag(left.rlike(rf"(?i)({'|'.join(NAMES)}|credential|private|bearer)[^\n]{{0,20}}$")),
        "assigned": flag(left.rlike("[:=]\\s*[\"'`]?$")),
        "hashed": flag(left.rlike(r"(?i)(commit|sha\d*|md5|checksum|hash|digest|uuid|guid|revision|integrity|etag|base64,|\bid)[^\n]{0,12}$")),
        "path": flag(left.rlike(r"(https?:|www\.|/|\\|\.)\S*$") | value.rlike("^/|/.*/|\\.[a-z]{2,4}$") | right.rlike("^(/|\\.[a-z]{2,4}\\b)")),
        "sample": flag(lower.rlike("x{4,}|example|your|changeme|placeholder|12345|abcdef|0{6,}|(.)\\1{5,}")),
        "known": flag(value.rlike("|".join(p for _, p in KINDS))),
    }
    return {k: F.coalesce(cols[k].cast("double"), F.lit(0.0)) for k in FEATURES}


#: Rows of the training set: the bound of the sample that the forest is fitted on.
TRAINING_ROWS = 6000


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = 0) -> DataFrame:
    """(left, value, right, label): a generated set of labelled findings, the same for the same seed.

    Positives are keys of common forms beside fitting words, or of well-known
    prefixes; negatives are what scanners wrongly report: commits, checksums,
    identifiers, numbers, long words, paths, encoded images and samples.
    """
    h = lambda k: F.sha2(F.concat_ws("-", F.col("id"), F.lit(seed), F.lit(k)), 256)
    pick = lambda k, *options: F.element_at(F.array(*(F.lit(o) if isinstance(o, str) else o for o in options)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(options))) + 1).cast("int"))
    b64 = lambda k, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(k), h(k + "'")))), "\\s", ""), 1, n)
    parts = PARTS.split("|")
    word = lambda k, n: F.concat(*(pick(f"{k}{i}", *parts[:30]) for i in range(n)))
    prose = F.concat_ws(" ", word("p", 2), word("q", 1), word("r", 3))
    name = pick("n", "token", "api_key", "secret", "password", "auth", "access_key", "apikey", "Token", "SECRET", "passwd")
    key = F.concat(name, pick("a", " = ", "=", ": ", " : ", ":"), pick("b", '"', "'", ""))
    hex40 = F.substring(h("x"), 1, 40)
    digits = lambda k, n: F.substring(F.regexp_replace(F.concat(h(k), h(k + "2"), h(k + "3")), "[a-f]", ""), 1, n)
    uuid = F.regexp_replace(F.substring(h("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    empty = F.lit("")
    forms = [
        # positives
        (key, hex40, 1),
        (key, pick("hx", F.substring(h("x"), 1, 32), h("x"), F.substring(h("x"), 1, 24)), 1),
        (key, b64("s", 40), 1),
        (key, b64("t", 24), 1),
        (key, F.concat(word("w", 1), F.substring(b64("v", 9), 1, 9), digits("d", 2)), 1),
        (pick("l", "", "key ", "export AWS_ACCESS_KEY_ID=", "AWS_ACCESS_KEY_ID="), F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(F.concat(h("k"), h("k2")), "[^a-f2-7]", "q"), 1, 16))), 1),
        (pick("l", "", "git clone with ", "auth "), F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64("g", 60), "[+/=]", "0"), 1, 36)), 1),
        (pick("l", "", "Stripe ", "key: "), F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(b64("g", 60), "[+/=]", "0"), 1, 24)), 1),
        (pick("l", "bearer ", "Authorization: Bearer "), F.concat(F.lit("eyJ"), b64("j", 60)), 1),
        (pick("l", "", "jwt ", "cookie "), F.concat(F.lit("eyJ"), F.substring(h("j1"), 1, 20), F.lit(".eyJ"), F.substring(h("j2"), 1, 30), F.lit("."), F.substring(h("j3"), 1, 43)), 1),
        (pick("l", "STRIPE_API_KEY=", "github_token=", "export DB_PASSWORD=", "AWS_SECRET_ACCESS_KEY="), b64("e", 32), 1),
        # negatives
        (pick("l", "commit ", "Merge commit ", "revision ", "fixed in "), hex40, 0),
        (pick("l", "md5: ", "sha256=", "checksum ", "hash: ", "digest ", "integrity="), pick("hy", F.substring(h("y"), 1, 32), h("y"), hex40), 0),
        (pick("l", "uuid ", "id: ", "guid=", "request id ", ""), uuid, 0),
        (F.concat(prose, F.lit(" ")), digits("c", 16), 0),
        (F.concat(prose, F.lit(" ")), word("lw", 6), 0),
        (F.concat(prose, F.lit(" ")), F.concat(F.initcap(word("lx", 4)), word("ly", 2)), 0),
        (F.concat(prose, F.lit(" ")), F.upper(word("lz", 5)), 0),
        (F.concat(prose, F.lit(" ")), F.concat_ws("-", word("m1", 2), word("m2", 2), word("m3", 1)), 0),
        (pick("l", "https://example.com/", "http://www.site.org/a/", "see /usr/lib/"), F.concat_ws("/", word("u1", 2), word("u2", 2), word("u3", 2)), 0),
        (F.lit("data:image/png;base64,"), F.concat(b64("i", 80), b64("i2", 80)), 0),
        (key, pick("smp", "xxxxxxxxxxxxxxxxxxxx", "your_token_goes_here", "changeme_changeme", "EXAMPLE_KEY_1234567890", "0000000000000000", "placeholder-placeholder"), 0),
        (pick("l", "", "----", "== "), pick("rule", "----------------------", "====================", "____________________"), 0),
    ]
    rows_of = spark.range(0, rows, 1, 1).withColumn("f", F.pmod(F.xxhash64("id", F.lit(seed), F.lit("form")), F.lit(len(forms))))
    chosen = lambda at: F.coalesce(*(F.when(F.col("f") == k, form[at]) for k, form in enumerate(forms)))
    return rows_of.select(F.concat(pick("lead", "", "the ", "with this ", "\n"), chosen(0)).alias("left"), chosen(1).alias("value"), F.concat(pick("q", '"', "'", "", " "), empty).alias("right"), F.coalesce(*(F.when(F.col("f") == k, F.lit(form[2])) for k, form in enumerate(forms))).alias("label"))


def cut_findings(findings: DataFrame) -> DataFrame:
    """(left, value, right, label) of the candidates that the scanner cuts from labelled findings; a candidate has the label if it holds part of the labelled value."""
    rows = findings.select(F.col("value").alias("said"), "label", F.concat(F.coalesce("left", F.lit("")), "value", F.coalesce("right", F.lit(""))).alias("text"))
    # written once: generated texts are long expressions, which each use would work out anew
    rows = with_candidates(checkpointed(rows), "text", "_").select("said", "label", F.explode_outer("_seen").alias("x")).where("x is not null")
    own = F.col("x.value").contains(F.col("said")) | F.col("said").contains(F.col("x.value"))
    return rows.select("x.left", "x.value", "x.right", F.when(own, F.col("label")).otherwise(0).alias("label"))


def train_forest(findings: DataFrame, words: list[str] = (), trees: int = 16, depth: int = 6, seed: int = 7) -> list:
    """A random forest over labelled findings (left, value, right, label), as nested (feature, split, low, high) tuples and votes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = cut_findings(findings)
    rows = rows.select(*(c.alias(k) for k, c in features(F.col("value"), F.col("left"), F.col("right"), words).items()), F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.coalesce(1)).select("x", "label")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    return [_parse(t.toDebugString) for t in model.trees]


def _parse(text: str):
    """A tree's printed form as nested tuples; a leaf is its class."""
    lines = [x.strip() for x in text.split("\n")[1:] if x.strip()]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        m = re.fullmatch(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line)
        low = node()
        at += 1  # the Else line
        return (int(m[1]), float(m[2]), low, node())

    return node()


def forest_score(forest: list, feature) -> Column:
    """The share of trees that vote for a secret; ``feature(name)`` gives a column."""

    def vote(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        at, split, low, high = tree
        return F.when(feature(FEATURES[at]) <= split, vote(low)).otherwise(vote(high))

    votes = [vote(t) for t in forest]
    return sum(votes[1:], votes[0]) / float(len(forest))


def with_candidates(docs: DataFrame, text_col: str, p: str) -> DataFrame:
    """``docs`` with ``{p}parts`` (text between candidates) and ``{p}seen``: (match, value, left, right) of each candidate; null and empty where there are none.

    Texts without a name are searched for runs alone, and texts with neither not at
    all: both give what the whole pattern gives.
    """
    text = F.col(f"`{text_col}`")
    low = F.lower(text)
    named = F.lit(False)
    for stem in STEMS:
        named = named | low.contains(stem)
    # the pattern that a text needs: 0 none, 1 runs, 2 all
    kind = F.when(named, 2).when(text.rlike(RUN), 1).otherwise(0)
    out = docs.withColumn(f"{p}kind", kind)
    by_kind = lambda f: F.when(F.col(f"{p}kind") == 2, f(CANDIDATE)).when(F.col(f"{p}kind") == 1, f(RUN))
    out = out.withColumn(f"{p}match", by_kind(lambda r: F.regexp_extract_all(text, F.lit(r), F.lit(0))))
    some = F.size(f"{p}match") > 0
    out = out.withColumn(f"{p}parts", F.when(some, by_kind(lambda r: F.split(text, r, -1))))

    def described(m: Column, i: Column) -> Column:
        value = F.regexp_replace(m, f"^{ASSIGNED}", "")
        name = F.substring(m, F.lit(1), F.length(m) - F.length(value))
        return F.struct(m.alias("match"), value.alias("value"), F.concat(F.right(F.get(f"{p}parts", i), F.lit(LEFT)), name).alias("left"), F.left(F.get(f"{p}parts", i + 1), F.lit(RIGHT)).alias("right"))

    return out.withColumn(f"{p}seen", F.when(some, F.transform(f"{p}match", described))).drop(f"{p}kind", f"{p}match")


def with_findings(docs: DataFrame, forest: list, text_col: str, p: str, words: list[str] = ()) -> DataFrame:
    """``docs`` with ``{p}parts`` (text between candidates) and ``{p}found``: (match, value, kind, score) of each candidate."""
    out = with_candidates(docs, text_col, p)
    out = out.withColumn(f"{p}features", F.transform(f"{p}seen", lambda x: F.struct(*(c.alias(k) for k, c in features(x.value, x.left, x.right, words).items()))))

    def scored(x: Column, f: Column) -> Column:
        kind = F.coalesce(*(F.when(x.value.rlike(r), F.lit(k)) for k, r in KINDS), F.lit("generic"))
        return F.struct(x.match.alias("match"), x.value.alias("value"), kind.alias("kind"), forest_score(forest, lambda name: f[name]).alias("score"))

    return out.withColumn(f"{p}found", F.zip_with(f"{p}seen", f"{p}features", scored)).drop(f"{p}seen", f"{p}features")


def find_secrets(docs: DataFrame, forest: list, id_col: str = "doc_id", text_col: str = "text", words: list[str] = ()) -> DataFrame:
    """(id, ordinal, start, length, value, kind, score, is_secret) of every candidate.

    ``start`` counts characters from 0; ``words`` are those that the forest was
    trained with. Null and empty texts have no candidates; repeated and null ids are
    scanned row by row; other columns aren't read; an empty table gives none.
    """
    rows = with_findings(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), forest, "text", "_", words).drop("text")
    # where each candidate starts: one running sum over a row's parts
    step = lambda s, x: F.struct((s.at + x.gap + x.size).alias("at"), F.array_append(s.starts, s.at + x.gap).alias("starts"))
    sizes = F.zip_with("_found", F.slice("_parts", F.lit(1), F.size("_found")), lambda x, gap: F.struct(F.length(gap).cast("long").alias("gap"), F.length(x.match).cast("long").alias("size")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    rows = rows.select("id", F.arrays_zip(F.col("_found").alias("x"), F.aggregate(sizes, zero, step, lambda s: s.starts).alias("at")).alias("found"))
    # an outer explode: a filter on the arrays would be pushed down and work everything out twice
    out = rows.select("id", F.posexplode_outer("found").alias("ordinal", "f")).where("ordinal is not null").select("id", "ordinal", F.col("f.x").alias("x"), F.col("f.at").alias("at"))
    start = F.col("at") + F.length("x.match") - F.length("x.value")
    return out.select(F.col("id").alias(id_col), F.col("ordinal").cast("long").alias("ordinal"), start.cast("long").alias("start"), F.length("x.value").cast("long").alias("length"), "x.value", "x.kind", "x.score", (F.col("x.score") >= THRESHOLD).alias("is_secret"))


def redact_secrets(docs: DataFrame, forest: list, text_col: str = "text", words: list[str] = ()) -> DataFrame:
    """``docs`` with every secret's value in the text replaced; all other columns and rows unchanged, whatever the columns' names, null texts stay null."""
    p = free_prefix(docs, "_s_")
    rows = with_findings(docs, forest, text_col, p, words)

    def safe(x: Column) -> Column:
        name = F.substring(x.match, F.lit(1), F.length(x.match) - F.length(x.value))
        return F.when(x.score >= THRESHOLD, F.concat(name, F.lit(REDACTED))).otherwise(x.match)

    rows = rows.withColumn(f"{p}safe", F.transform(f"{p}found", safe))
    clean = F.array_join(F.flatten(F.transform(f"{p}parts", lambda x, i: F.array(x, F.coalesce(F.get(f"{p}safe", i), F.lit(""))))), "")
    secret = F.coalesce(F.exists(f"{p}found", lambda x: x.score >= THRESHOLD), F.lit(False))
    return rows.withColumn(text_col, F.when(secret, clean).otherwise(F.col(f"`{text_col}`"))).select(*(F.col(f"`{c}`") for c in docs.columns))
