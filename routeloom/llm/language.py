"""Language identification by compression.

Each language has a zstandard raw-content dictionary of excerpts from its labelled texts.  A text is cut into
blocks, each block is compressed with every dictionary, and the language with the fewest bytes over all blocks
wins.  The score is the share of bytes that the winner saves against the runner-up; a text whose score
is under `margin` is marked as rejected.

At most `sample_per_language` distinct labelled texts of a language make its dictionary: those with the least digests, of
each an excerpt.  Copies count once, so a hot text can't fill the sample; this bounds what the driver holds.  Prediction
covers every text whole.

Defined results: a null text or one without letters is `und` with score 0 and rejected; ties go to the first
language by code point with score 0; with no labelled rows every text is `und`; a null id is not held out; repeated rows
are each predicted; a long text is compressed block by block; an empty table gives no rows.  Columns of the input that are
named like a result are replaced; all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
BLOCK = 1 << 14
LEVEL = 6
EXCERPT = 600
SMALLEST = 32 << 10
RESULTS = ("lang_pred", "score", "rejected")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def dictionaries(labelled: DataFrame, sample_per_language: int = 400, dictionary_bytes: int = 112 << 10) -> dict[str, bytes]:
    """One raw dictionary a language, from (text, lang) rows; rows with null in either are left out."""
    rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return {}
    rank = F.xxhash64("text").cast("double") / float(1 << 64) + 0.5
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, sample_per_language / n)))])
    long = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(max(EXCERPT, 2 * dictionary_bytes // min(n, sample_per_language))))])[F.col("lang")]
    start = F.pmod(F.xxhash64(F.lit("excerpt"), "text"), F.greatest(F.length("text") - long, F.lit(1))).cast("int") + 1
    # three times the share before copies are merged; then the least ranks of each language
    drawn = rows.where(rank <= 3 * share[F.col("lang")]).select("lang", rank.alias("rank"), F.col("text").substr(start, long).alias("excerpt"))
    distinct = drawn.groupBy("lang", "rank").agg(F.min("excerpt").alias("excerpt"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    sample = distinct.withColumn("place", place).where(F.col("place") <= sample_per_language).select("lang", "rank", "excerpt")
    pieces: dict[str, list[tuple[float, str]]] = {}
    for lang, r, excerpt in sample.collect():
        pieces.setdefault(lang, []).append((r, letters(excerpt)))
    raw = {k: " ".join(x for _, x in sorted(pieces.get(k, []))).encode() for k in sorted(counts)}
    same = min(dictionary_bytes, max(SMALLEST, min(map(len, raw.values()))))  # a longer dictionary would win for its length
    return {k: x[:same] for k, x in raw.items()}


def classifier(models: Mapping[str, bytes], level: int = LEVEL):
    """A function from a text to (language, score)."""
    compressors = []
    for lang, raw in sorted(models.items()):
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=level)
        compressors.append((lang, zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)))
    frame = len(zstandard.ZstdCompressor(level=level, write_content_size=False).compress(b""))

    def classify(text: str | None) -> tuple[str, float]:
        raw = letters(text or "").encode()
        if not raw or not compressors:
            return UNDETERMINED, 0.0
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = sorted((sum(len(c.compress(x)) - frame for x in blocks), lang) for lang, c in compressors)
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], max(0.0, 1.0 - max(sizes[0][0], 0) / max(sizes[1][0], 1))

    return classify


def _predict(batches: Iterator[pa.RecordBatch], models, margin: float) -> Iterator[pa.RecordBatch]:
    classify = classifier(models.value)
    for batch in batches:
        found = [classify(t) for t in batch["text"].to_pylist()]
        columns = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[0] == UNDETERMINED or x[1] < margin for x in found])]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, models: Mapping[str, bytes], margin: float = 0.005) -> DataFrame:
    """The columns of `docs` (one of them `text`), then lang_pred, score and rejected in place of any of these names."""
    docs = docs.drop(*RESULTS)
    shared = docs.sparkSession.sparkContext.broadcast(dict(models))
    fields = [f"`{name}` {kind}" for name, kind in docs.dtypes]
    return docs.mapInArrow(lambda it: _predict(it, shared, margin), ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"]))
