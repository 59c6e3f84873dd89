"""Functions that Spark lacks, as Arrow-batched UDFs over plain Python."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: All combining marks lie beyond these.
_BEYOND = re.compile(r"[^\x00-\u02ff]")
#: Letters of texts that are taken from a batch and folded together, if there are so many, and texts at most.
_LETTERS, _TEXTS = 1 << 18, 256


def _plain(x: str | None) -> str | None:
    if x is None or x.isascii():
        return x
    x = unicodedata.normalize("NFKD", x)
    return "".join(c for c in x if not unicodedata.combining(c)) if _BEYOND.search(x) else x


@F.arrow_udf(T.StringType())
def folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compatibility decomposition without combining marks; null stays null. The one step that Spark has no function for.

    A worker holds a batch as Arrow has it, its result, and a few texts as Python strings,
    and gives Arrow's memory back before the next.
    """
    for batch in batches:
        yield _folded_batch(batch)
        del batch
        pa.default_memory_pool().release_unused()


def _folded_batch(batch: pa.Array) -> pa.Array:
    kind, parts, texts, letters = pa.string(), [], [], 0
    for x in batch:
        x = _plain(x.as_py())
        texts.append(x)
        letters += len(x or "")
        if letters >= _LETTERS or len(texts) >= _TEXTS:
            parts.append(pa.array(texts, kind))
            texts, letters = [], 0
    return pa.concat_arrays([*parts, pa.array(texts, kind)])


def _folded(c) -> Column:
    return folded(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def norm_title(c) -> Column:
    """Accents dropped, lowered, anything but a-z and 0-9 one blank."""
    return F.btrim(F.regexp_replace(F.lower(_folded(c)), "[^a-z0-9]+", " "))


def raw_slug(stem) -> Column:
    """An ASCII slug of a file's stem."""
    plain = F.lower(F.regexp_replace(_folded(stem), r"[^\x00-\x7F]", ""))
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def slugify(c) -> Column:
    """An ASCII slug of at most 60 letters."""
    return F.substring(raw_slug(c), 1, 60)


def _normal(s: pd.Series) -> pd.Series:
    return s.fillna("").map(_plain).str.lower().str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, first argument first: it isn't symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of normalised titles; 0 if either is empty."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(_normal(a), _normal(b), strict=True)])


@F.pandas_udf(T.StringType())
def yaml_to_json(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A YAML mapping as JSON, dates as ISO text; null if it doesn't parse, an empty object if it's no mapping."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            found = yaml.load(x, loader)
        except Exception:  # any fault of the document, also in its constructors
            return None
        return json.dumps(found if isinstance(found, dict) else {}, default=str)

    for part in raw:
        yield part.map(one)


def match_offsets(pattern: str, groups: int, flags: int = re.IGNORECASE):
    """A UDF: array of (start, end, whole, groups) of every match of a pattern."""
    compiled = re.compile(pattern, flags)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("whole", T.StringType()), T.StructField("groups", T.ArrayType(T.StringType()))])))
    def found(s: pa.Array) -> pa.Array:
        at, start, end, whole, parts = [0], [], [], [], []
        for x in s.to_pylist():
            for m in compiled.finditer(x or ""):
                start.append(m.start())
                end.append(m.end())
                whole.append(m.group())
                parts += m.groups()[:groups]
            at.append(len(start))
        each = pa.ListArray.from_arrays(pa.array(range(0, groups * len(start) + 1, groups) if groups else [0] * (len(start) + 1), pa.int32()), pa.array(parts, pa.string()))
        columns = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(whole, pa.string()), each]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "end", "whole", "groups"]))

    return found


def figure_slug(caption, most: int = 8) -> Column:
    """The first informative words of a caption."""
    from .text import FIGURE_STOP, none_if_empty

    words = F.regexp_extract_all(F.lower(_folded(caption)), F.lit("([a-z0-9]+)"), F.lit(1))
    telling = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*FIGURE_STOP))
    shown = F.slice(F.when(F.size(telling) > 0, telling).otherwise(words), 1, most)
    return F.coalesce(none_if_empty(F.array_join(shown, "-")), F.lit("untitled"))


_OPF = {"dc": "http://purl.org/dc/elements/1.1/", "opf": "http://www.idpf.org/2007/opf"}


def opf_metadata(data: bytes) -> dict:
    """Title, people by role, publisher, ISBN, language and year of an EPUB; empty fields where it says nothing."""
    empty = {"title": None, "authors": [], "editors": [], "publisher": None, "isbn": None, "language": None, "year": None}
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            name = next((n for n in z.namelist() if n.endswith(".opf")), None)
            root = ElementTree.fromstring(z.read(name)) if name else None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return empty
    if root is None:
        return empty
    said = lambda tag: [(e, e.text.strip()) for e in root.iterfind(f".//dc:{tag}", _OPF) if e.text and e.text.strip()]
    first = lambda tag: next((t for _, t in said(tag)), None)
    attribute = lambda e, name: e.get(f"{{{_OPF['opf']}}}{name}", "")
    people = [(name, attribute(e, "role") == "edt") for e, name in said("creator")]
    # an identifier is an ISBN only where its scheme or its text says so
    isbns = (re.sub(r"[^0-9X]", "", t.upper()) for e, t in said("identifier") if attribute(e, "scheme").lower() == "isbn" or "isbn" in t.lower())
    years = (m.group() for _, t in said("date") if (m := re.search(r"\d{4}", t)))
    year, language = next(years, None), first("language")
    return empty | {
        "title": first("title"), "publisher": first("publisher"), "language": language.lower()[:2] if language else None, "year": int(year) if year else None,
        "authors": [n for n, editor in people if not editor], "editors": [n for n, editor in people if editor], "isbn": next((d for d in isbns if len(d) in (10, 13)), None),
    }


# types, not text: text would need a session at import
_TEXT, _LIST = T.StringType(), T.ArrayType(T.StringType())


@F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in (("title", _TEXT), ("authors", _LIST), ("editors", _LIST), ("publisher", _TEXT), ("isbn", _TEXT), ("language", _TEXT), ("year", T.IntegerType()))]))
def epub_metadata(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([opf_metadata(bytes(x)) for x in data], columns=["title", "authors", "editors", "publisher", "isbn", "language", "year"])


@F.pandas_udf(T.StringType())
def with_fields(content: pd.Series, fields: pd.Series) -> pd.Series:
    """Pages with frontmatter fields set from a JSON object, those of null values dropped; other fields and their order stay."""
    import yaml

    def one(text: str, patch: str) -> str:
        m = re.match(r"(?s)\A---\n(.*?)\n---\n", text)
        own = (yaml.safe_load(m[1]) if m else None) or {}
        new = {k: v for k, v in (own | json.loads(patch)).items() if v is not None or k in own.keys() - json.loads(patch).keys()}
        head = yaml.safe_dump(new, allow_unicode=True, sort_keys=False).strip()
        return f"---\n{head}\n---\n\n{text[m.end() if m else 0 :].lstrip()}"

    return pd.Series([one(c, p) for c, p in zip(content, fields, strict=True)])
