"""What the driver holds of samples, and how many tasks it sees in repeated passes."""

import random
import tracemalloc

from pyspark.sql import functions as F

from aforo.llm import language, mixing
from aforo.llm.common import stored


def test_the_driver_holds_little_more_than_one_matrix(spark, documents):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "s", lang) for i, (lang, words) in enumerate([("en", ["the", "and", "word"]), ("de", ["und", "der", "wort"])] * 400)]
    docs = documents(rows)
    tracemalloc.start()
    model = language.fit(docs, F.lit(True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.names == ["germanic"] and peak < 2.6 * 800 * (language.BINS + 1) * 4


def test_passes_over_labelled_rows_have_few_tasks(spark, documents, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["word", "W0RD", "a.b", "12"]) for _ in range(30))) for i in range(200)]
    docs = documents(rows).repartition(40)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int").repartition(40)
    monkeypatch.setattr(mixing, "stored", lambda df, name: stored(df.repartition(20), name))
    fitted, parts = mixing.LogisticRegression.fit, []
    monkeypatch.setattr(mixing.LogisticRegression, "fit", lambda self, data: (parts.append(data.rdd.getNumPartitions()), fitted(self, data))[1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        mixing.fitted_quality(docs, labels)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts == [1]
