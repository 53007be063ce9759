"""Token counts with a digest cache.

The cache is a Parquet table (content, tokenizer, n_tokens).  `content` is the SHA-256 of the text as the
tokenizer sees it; the only normalisation that leaves every count unchanged is null to empty, as the model
keeps case, white space and combining marks apart.  `tokenizer` is the SHA-256 of the model file and the
library's version.  Texts without a cached count are reduced to distinct ones, encoded, and appended.

Inside a task, a text is cut before each space that follows another character: when no piece of the vocabulary
has a space mark after its start run of marks, no merge crosses such a cut, so the counts of the parts add up.  Parts
repeat, so each worker remembers their counts.  A vocabulary without that property, and any text in which
the cut would not be exact, is encoded whole.

Defined results: a null or empty text has 0 tokens; equal texts are encoded once; repeated rows and a null id are kept; long
texts count whole; an empty table gives no rows.  Only the named columns are read.  The cache of another run with the same
path is used where content and tokenizer agree; without a path the cache lives for one call.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import scratch_path, text_of
from .shingles import row_slices

MARK = "▁"
REMEMBERED = 400_000
CACHE = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(model: bytes) -> str:
    return hashlib.sha256(model + sentencepiece.__version__.encode()).hexdigest()


def separable(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece has a space mark after another character."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(MARK in p.lstrip(MARK) for p in pieces)


def _encode(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    processor = sentencepiece.SentencePieceProcessor(model_proto=model.value)
    whole_only = not separable(processor)
    known: dict[str, int] = {}
    for batch in batches:
        for a, b in row_slices(batch["text"]):
            texts = batch["text"].slice(a, b - a).to_pylist()
            parts = [None if whole_only or MARK in t or t[:1] in ("", " ") or t[-1:] == " " or "  " in t else t.split(" ") for t in texts]
            if len(known) > REMEMBERED:
                known = {}
            new = list({w for p in parts if p for w in p}.difference(known))
            known.update(zip(new, map(len, processor.encode(new, num_threads=1)), strict=True))
            counts = [len(processor.encode(t)) if p is None else sum(map(known.__getitem__, p)) for t, p in zip(texts, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["content"].slice(a, b - a), pa.array(counts, pa.int64())], ["content", "n_tokens"])


def _cached(spark, path: str, tokenizer: str) -> DataFrame:
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:  # no cache yet
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model_path: str, cache_path: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; new counts are appended to `cache_path`."""
    spark = docs.sparkSession
    model = Path(model_path).read_bytes()
    tokenizer, shared = tokenizer_digest(model), spark.sparkContext.broadcast(model)
    cache_path = cache_path or scratch_path(spark, "token-cache")
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("content", F.sha2("text", 256))
    distinct = keyed.select("content", "text").dropDuplicates(["content"])
    misses = distinct.join(_cached(spark, cache_path, tokenizer), "content", "left_anti")
    fresh = misses.select("content", "text").mapInArrow(lambda it: _encode(it, shared), "content string, n_tokens long")
    fresh.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return rows.join(_cached(spark, cache_path, tokenizer), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
