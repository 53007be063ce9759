"""Mixing sources to target weights by capped water-filling.

Sources in code-point order (null last) get the weights in turn.  Every source's target is its share of
`budget` times all words, but at most `cap` times its own words; what a clamp frees is shared again by
weight until no target is above its clamp.  A source then takes each of its documents floor(target / size)
whole times, and the fractional repetition goes to its documents in the order of a seeded digest until
the target is met, the last of them in part.

Defined results: a null text has size 0; a null source is a source of its own; rows that agree in id and
text share their part evenly; repeated ids with other texts and extra columns change nothing; sources that reach their
clamp together are clamped together; a table without words has targets of 0; an empty table gives no rows.  Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, text_of

#: Sources that every task may get, of a few numbers each.
FEW_SOURCES = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def _ranked(sources: DataFrame) -> DataFrame:
    """Position of each source in code-point order, null last, without gathering the sources in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = stash(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    offset, pairs = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):
        pairs += [F.lit(part), F.lit(offset)]
        offset += n
    before = F.create_map(*pairs)[F.col("part")] if pairs else F.lit(0)
    return placed.withColumn("place", before + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).drop("part")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """`sizes` (source, source_size) with `target`.

    In the order of the level at which they clamp, sources before a place are clamped and the others share what is left by weight; the first place whose source
    stays below its clamp gives the level.  The sums before a place are those of its range plus the ranges before, so no task sorts all sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    most = F.col("source_size") * F.lit(cap)
    ranked = _ranked(sizes).withColumn("weight", weight).withColumn("most", most).withColumn("clamps", F.col("most") / F.col("weight"))
    placed = stash(ranked.repartitionByRange("clamps", "place").withColumn("part", F.spark_partition_id()), "clamps")
    whole, before = Window.partitionBy(), Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part").agg(F.sum("source_size").alias("_s"), F.sum("most").alias("_m"), F.sum("weight").alias("_w"))  # a row a range
    zero = F.lit(0.0)
    carried = sums.select("part", F.sum("_s").over(whole).alias("_total"), F.sum("_w").over(whole).alias("_weights"), F.coalesce(F.sum("_m").over(before), zero).alias("_most"), F.coalesce(F.sum("_w").over(before), zero).alias("_weight"))
    own = Window.partitionBy("part").orderBy("clamps", "place").rowsBetween(Window.unboundedPreceding, -1)
    clamped = F.col("_most") + F.coalesce(F.sum("most").over(own), zero)
    sharing = F.col("_weights") - F.col("_weight") - F.coalesce(F.sum("weight").over(own), zero)
    levels = placed.join(F.broadcast(carried), "part").withColumn("level", (budget * F.col("_total") - clamped) / sharing).where(F.col("level") * F.col("weight") <= F.col("most"))
    found = levels.agg(F.min_by("level", F.struct("clamps", "place"))).first()[0]
    target = F.col("most") if found is None else F.least(F.lit(found) * F.col("weight"), "most")
    return placed.select("source", "source_size", target.alias("target"))


def _source_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))


def _boundary(sums: DataFrame, by: str) -> DataFrame:
    """The bucket of each source in which its words in digest order reach `need`; `rest` is what that bucket owes."""
    after = F.sum("words").over(Window.partitionBy("sk").orderBy(by))
    return sums.withColumn("after", after).where((F.col("after") > F.col("need")) & (F.col("after") - F.col("words") <= F.col("need"))).select("sk", F.col(by), (F.col("need") - F.col("after") + F.col("words")).alias("rest"), "words")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken, repeats): the words and whole repetitions the mix takes of each row."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(text_of())))
    rows = docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORDS)).cast("long").alias("size"), digest.alias("key"))
    rows = stash(rows.withColumn("sk", _source_key("source")), "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    need = F.floor(F.col("target") - whole * F.col("source_size") + 0.5).cast("long")
    targets = stash(source_targets(sizes, weights, budget, cap).select(_source_key("source").alias("sk"), "source_size", "target", whole.alias("whole"), need.alias("need")), "targets")

    # Three steps down the digest: its first 12 bits, its next 12, then the digests of one small bucket.
    first, second = F.substring("key", 1, 3), F.substring("key", 4, 3)
    sums = rows.groupBy("sk", first.alias("b1")).agg(F.sum("size").alias("words")).join(targets.select("sk", "need"), "sk")
    edge1 = stash(_boundary(sums, "b1").drop("words"), "edge1")  # a row for each source; without it each step plans all before it again
    inner = rows.withColumn("b1", first).join(edge1, ["sk", "b1"])
    sums = inner.groupBy("sk", second.alias("b2"), F.col("rest").alias("need")).agg(F.sum("size").alias("words"))
    edge2 = stash(_boundary(sums, "b2").drop("words"), "edge2")
    inner = inner.drop("rest").withColumn("b2", second).join(edge2, ["sk", "b2"])
    sums = inner.groupBy("sk", "key", F.col("rest").alias("need")).agg(F.sum("size").alias("words"), F.count("*").alias("ties"))
    counts = sums.select("sk", "key", "ties")
    edge = _boundary(sums, "key").join(counts, ["sk", "key"]).select("sk", F.col("key").alias("edge_key"), F.floor(F.col("rest") / F.col("ties")).cast("long").alias("part"))

    extra = F.when(F.col("need") <= 0, 0).when(F.col("edge_key").isNull() | (F.col("key") < F.col("edge_key")), F.col("size")).when(F.col("key") == F.col("edge_key"), F.col("part")).otherwise(0)
    edges = stash(targets.join(edge, "sk", "left"), "edges")
    if edges.count() <= FEW_SOURCES:  # a hot source then stays spread over its tasks; else skewed joins are split at run time
        edges = F.broadcast(edges)
    joined = rows.join(edges, "sk")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"), F.col("whole").alias("repeats"))
