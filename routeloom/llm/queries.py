"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, decontaminate, language, licenses, mixing, near_dups, periodic, pii, repeats, secrets, spelling, token_counts, warc
from .common import span_counts, span_labels, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.label(table(spark, sf_dir, "documents"))


def _spans(found: DataFrame, base: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    spans = F.col("spans")
    strict = F.filter(spans, lambda s: s["kind"] < len(base))
    return found.select("doc_id", *span_counts(spans, base), F.sha2(span_labels(strict, kinds), 256).alias("base_sha256"), span_labels(spans, kinds).alias("spans"), F.size(spans).cast("long").alias("n_found"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return _spans(found, tuple(r.kind for r in secrets.BASE), tuple(r.kind for r in secrets.RULES))


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.strip_repeats(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op6_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.describe(avi.store(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = language.dictionaries(docs.where(F.col("doc_id").isNotNull() & ~language.held_out()))
    found = language.identify(docs.select("doc_id", "text"), models)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _spans(pii.find_pii(docs, pii.fit(docs)), pii.KINDS, pii.KINDS + pii.FAMILIES)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.summary(periodic.find_runs(periodic.with_repeated_tails(docs)))


def op12_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_secrets": op2_secrets,
    "op3_repeated_strings": op3_repeated_strings,
    "op4_mix_sources": op4_mix_sources,
    "op5_licenses": op5_licenses,
    "op6_avi_media": op6_avi_media,
    "op7_token_counts": op7_token_counts,
    "op8_language": op8_language,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_warc_round_trip": op12_warc_round_trip,
    "op13_spelling_variants": op13_spelling_variants,
}
