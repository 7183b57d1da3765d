"""What op8 learns from is bounded whatever ids and copies there are."""

from pyspark.sql import functions as F

from colloquy.llm import langid


def test_sample_is_bounded_without_ids(spark, monkeypatch):
    """NULL ids, one row copied without end, and rows of their own: at most the bound reaches the driver."""
    rows = spark.range(6000).select(
        F.lit(None).cast("bigint").alias("doc_id"),
        F.concat(F.when(F.col("id") % 2 == 0, "der und die ").otherwise("the and of "), "id").alias("text"),
        F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"),
    )
    copies = spark.range(6000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the same row").alias("text"), F.lit("en").alias("lang"))
    seen = []
    inner = langid._sparse
    monkeypatch.setattr(langid, "_sparse", lambda df: seen.append(df.select("_lang", "_text").collect()) or inner(df))
    docs = rows.unionByName(copies)
    model = langid.train(docs, F.lit(True), per_language=60)
    by = {}
    for lang, text in seen[0]:
        by.setdefault(lang, []).append(text)
    assert len(by["de"]) == 60 and 20 <= len(by["en"]) <= 60
    assert all(len(set(t)) == len(t) for t in by.values())
    got = langid.predict(docs.limit(0).union(spark.createDataFrame([(1, "die und der", "x"), (2, "of the and", "x")], docs.schema)), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "de", 2: "en"}
    langid.train(docs, F.lit(True), per_language=60, most_rows=20)
    assert max(sum(lang == x for lang, _ in seen[1]) for x in ("de", "en")) == 10
    again = langid.train(docs.repartition(7), F.lit(True), per_language=60)
    assert (again.weights == model.weights).all() and again.temperature == model.temperature
