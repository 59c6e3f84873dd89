"""The master bibliography's order."""

from pyspark.sql import functions as F

from quillspark.operators import citations


def test_entries_of_one_slug_have_one_order(spark):
    """Sources of the same year and slug come in one order, in whatever order and partitions they are read."""
    none = F.lit(None).cast("string")

    def chunks(titles, parts):
        rows = spark.createDataFrame([("s", t, 2001) for t in titles], "slug string, title string, year int").repartition(parts)
        rows = rows.withColumns({"bibtex_key": none, "authors": F.array(F.lit("A One")), "tags": F.array().cast("array<string>"), "source_pdf": none, "degree": none, "university": none, "doi": none, "journal": F.lit("J"), "intervention_family": F.lit("none"), "methods": F.array().cast("array<string>"), "domain": F.array(F.lit("J"))})
        return [r["chunk"] for r in citations.bibtex_master(rows).orderBy("k").collect()]

    titles = [f"title {k}" for k in range(8)]
    first = chunks(titles, 1)
    assert [c.partition("title    = {")[2][:7] for c in first] == titles
    assert chunks(titles[::-1], 1) == first == chunks([*titles[3:], *titles[:3]], 4)
