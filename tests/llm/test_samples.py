"""Training samples are bounded whatever the ids are."""

import pytest
from pyspark.sql import functions as F

from rolebook.llm import langid, quality, secret_scan, toxicity
from rolebook.llm import texts as X


@pytest.fixture(scope="module")
def table(spark):
    """30,000 texts, some of them alike; ids null, one for all, or their own."""
    text = F.concat(F.lit("text number "), F.col("id") % 20_000, F.lit(" token=abc"), F.col("id") % 700)
    df = spark.range(30_000).select("id", text.alias("text"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"))
    return df.repartition(4)


@pytest.mark.parametrize("kind", ["null", "one", "own"])
def test_bound(table, kind):
    ids = {"null": F.lit(None).cast("long"), "one": F.lit(7).cast("long"), "own": F.col("id")}[kind]
    df = table.select(ids.alias("doc_id"), "text", "lang", F.lit(1).alias("h"), F.lit("x").alias("place"))
    got = X.sample(df, 500)
    assert got.columns == df.columns and got.count() == 500
    assert got.select("doc_id", "text").distinct().count() == 500
    each = X.sample(df, 100, by="lang").groupBy("lang").count().collect()
    assert sorted((r.lang, r["count"]) for r in each) == [("de", 100), ("en", 100)] or all(r["count"] <= 100 for r in each)
    assert X.sample(df.limit(50), 500).count() == 50
    assert X.sample(df.limit(0), 500).collect() == []


def test_rows_alike_count_once(spark):
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert X.sample(df, 100).count() <= 1


@pytest.mark.parametrize("kind", ["null", "one"])
def test_operators(table, monkeypatch, kind):
    """Each trains on a bounded part and judges every row."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 50)
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(secret_scan, "SAMPLE_DOCS", 100)
    ids = F.lit(None).cast("long") if kind == "null" else F.lit(7).cast("long")
    df = table.select(ids.alias("doc_id"), "text", "lang")
    seen = []
    real = langid.fit_counts
    monkeypatch.setattr(langid, "fit_counts", lambda rows, names: seen.append(rows.count()) or real(rows, names))
    assert langid.identify(df, F.lit(True)).count() == 30_000
    assert seen and seen[0] <= 100
    assert quality.cascade(df).count() == 30_000
    assert secret_scan.find(df, secret_scan.train(df)).count() == 30_000


def test_one_text_an_id(table):
    """A labelled id that very many rows share teaches one text."""
    docs = table.select(F.lit(7).cast("long").alias("doc_id"), "text")
    labels = docs.sparkSession.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert model.bias == toxicity.train(docs.limit(1), labels, F.lit(True)).bias > 0


def test_langid_table_is_bounded(spark, monkeypatch):
    """Every order is bounded; predictions still tell plain languages apart."""
    monkeypatch.setattr(langid, "CELLS", 20_000)
    rows = [(i, "the of and to that this with " * 20 if i % 2 else "der und die das nicht mit ein " * 20, "en" if i % 2 else "de") for i in range(60)]
    noise = [(100 + i, "".join(chr(33 + (i * 31 + j * j * 17) % 90) for j in range(2000)), "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame(rows + noise, "doc_id long, text string, lang string")
    (model,) = langid.train(df, F.lit(True)).blocks()
    assert model.bits.size <= 20_000 + model.bits.shape[1] * model.bits.shape[2]
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, F.lit(True)).collect()}
    assert all(got[i] == ("en" if i % 2 else "de") for i in range(60))
