"""The pipeline's stages on a small corpus."""

import random

import corpus_pipeline
from routeloom.llm.common import stash


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    vocabulary = {lang: [word() for _ in range(150)] for lang in ("aa", "bb")}
    text = lambda lang: " ".join(rng.choice(vocabulary[lang]) for _ in range(60))
    rows = [(k, text(lang), lang, f"s{k % 2}", 1) for k in range(80) for lang in [("aa", "bb")[k % 2]]]
    item = text("aa")
    rows += [(100, rows[0][1], "aa", "s0", 1), (101, text("aa") + " " + item, "aa", "s1", 1), (102, text("bb") + " token = 0123456789abcdef0123", "bb", "s0", 1), (103, None, "aa", "s0", 0), (104, "12", None, None, 2)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, folder), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["language"]) == {*range(80), 100, 101, 102}
    assert set(kept["near_duplicates"]) == {*range(80), 101, 102}
    assert set(kept["decontaminate"]) == {*range(80), 102} == set(kept["secrets"]) == set(kept["mix"])
    assert kept["secrets"][102].text.endswith("[SECRET]") and kept["secrets"][102].n_chars == len(kept["secrets"][102].text)
    assert kept["secrets"][5].text == rows[5][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "secrets", "mix"]


def test_odd_rows(spark, tmp_path):
    """Each stage on nulls, empty texts, repeated rows and ids, extra columns, and empty tables."""
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a, "aa", "s", 1), (1, a, "aa", "s", 1), (2, b, None, None, None), (2, c, "aa", "s", 1), (None, None, None, None, None), (3, "", "aa", "s", 0), (4, "12", None, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' AS lang_pred", "1 AS size", "'d' AS digest")
    benchmark = "item_id long, text string"
    for name, items in (("some", [(1, c), (2, None), (2, ""), (None, "two words")]), ("none", [])):
        spark.createDataFrame(items, benchmark).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    stages, folder = dict(corpus_pipeline.STAGES), f"{tmp_path}/some"
    ids = lambda frame: sorted((r.doc_id for r in frame.collect()), key=str)
    assert set(ids(stages["language"](spark, docs, folder))) <= {1, 2}
    kept = stages["near_duplicates"](spark, docs, folder)
    assert ids(kept) == [1, 2, 2, 3, 4, None] and kept.columns == list(corpus_pipeline.COLUMNS)
    assert ids(stages["decontaminate"](spark, docs, folder)) == [1, 1, 2, 3, 4, None]
    assert len(ids(stages["decontaminate"](spark, docs, f"{tmp_path}/none"))) == len(rows)
    masked = stages["secrets"](spark, docs, folder)
    assert len(ids(masked)) == len(rows) and {r.text or "" for r in masked.collect()} == {r[1] or "" for r in rows}
    mixed = stages["mix"](spark, docs, folder).collect()
    assert len(mixed) == len(rows) and all(r.taken <= 2 * r.size for r in mixed)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
