"""Plans stay small: one query of many stages is planned anew at each of them, in the driver's memory."""

import random

from routeloom.llm import mixing, near_dups


def most_jobs(spark, run):
    """The most jobs that one query of `run` takes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.executionsList(int(before), 1000)
    return max(found.apply(k).jobs().size() for k in range(found.size()))


def test_no_query_of_near_duplicates_or_mixing_has_many_jobs(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "CELL_TEXTS", 8)
    rng = random.Random(5)
    base = [f"word{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for k in range(80):
        words = list(base)
        for _ in range(k % 12):
            words[rng.randrange(100)] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(words), f"source{k % 4}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert most_jobs(spark, lambda: near_dups.label(docs).collect()) <= 16
    assert most_jobs(spark, lambda: mixing.mix(docs).collect()) <= 14
