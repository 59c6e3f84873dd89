"""Folding holds few texts of a batch at a time, and gives what it gave."""

import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import python as P


def test_a_batch_is_folded_in_small_steps(spark):
    odd = ["Éà ﬁ ½ ㎏ Å K", "ascii", "", None, "한국어 ǅ ॐ क़", "ẹ́ ß ſ", "\U0001d400"]
    want = [x if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) for x in odd]
    assert P._folded_batch(pa.array(odd * 100, pa.string())).to_pylist() == want * 100
    assert P._folded_batch(pa.array([], pa.string())).to_pylist() == []
    df = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, x string").select("k", P.folded(F.col("x")).alias("y"))
    assert [r["y"] for r in df.orderBy("k").collect()] == want
    batch = pa.array(["é texte " * 250] * 8000, pa.string())  # 18 MB
    tracemalloc.start()
    P._folded_batch(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
