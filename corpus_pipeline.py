"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns the rows that it keeps.

All but the last return the columns of `documents`.  The first drops documents whose language is rejected, the second keeps
one document of each near-duplicate class, the third drops documents that hold a benchmark item, the fourth masks secrets
in the text, and the last mixes what is left to the source weights.

Defined results.  A null or empty text and one without letters is rejected by the first stage; called on such rows, the later
stages keep them (no words: no copy, no item, no secret, size 0).  Rows that repeat an id are rows of their own: equal texts
leave one of them, different texts stay, and each goes or stays for its own text.  Null ids, languages and
sources are kept, a null source being a source; a null n_chars stays null unless a secret is masked.  An empty benchmark
drops nothing; empty documents give no rows.  Columns other than those of `documents` are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import decontaminate, language, mixing, near_dups, secrets
from routeloom.llm.common import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = language.dictionaries(docs.where(F.col("doc_id").isNotNull() & ~language.held_out()))
    return language.identify(docs.select(*COLUMNS), models).where(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(docs, keep=("doc_id", "lang", "source", "n_chars"))
    masked = F.when(F.size("spans") > 0, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    text = found.withColumn("hit", F.size("spans") > 0).select("doc_id", masked.alias("text"), "lang", "source", "n_chars", "hit")
    return text.select("doc_id", "text", "lang", "source", F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: Compression and sketches have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
