"""Prefix-trie operations as joins.

A containment test over two tables would be a nested loop.  Instead each prefix is exploded into its ancestors, only at
the lengths that the other side has (129 at most), and met by an equi-join, which Spark hashes, sorts and splits by skew.
Prefix columns are (ver, hi, lo, len) structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip
from .ipspace import union_v4

LESS, EXACT, MORE = 4, 2, 1


def key(prefix: Column) -> Column:
    return F.struct(prefix["ver"].alias("ver"), prefix["len"].alias("len"), prefix["hi"].alias("hi"), prefix["lo"].alias("lo"))


def lengths(prefixes: DataFrame, column: str = "prefix") -> dict[int, list[int]]:
    """The lengths that occur for each version: at most 33 and 129 values."""
    found = {4: [], 6: []}
    for ver, length in prefixes.select(F.col(column)["ver"].alias("v"), F.col(column)["len"].alias("l")).distinct().where("v is not null").collect():
        found[ver].append(length)
    return {v: sorted(x) for v, x in found.items()}


def ancestors(rows: DataFrame, at: dict[int, list[int]], column: str = "prefix", strict: bool = False) -> DataFrame:
    """`rows` with `ancestor`: the prefix itself (unless strict) and those above it, at the given lengths."""
    p = F.col(column)
    lists = F.when(p["ver"] == 4, F.array(*map(F.lit, at[4])).cast("array<int>")).otherwise(F.array(*map(F.lit, at[6])).cast("array<int>"))
    fits = F.filter(lists, lambda n: (n < p["len"]) if strict else (n <= p["len"]))
    exploded = rows.withColumn("_n", F.explode(fits))
    return exploded.withColumn("ancestor", ip.make_prefix(p["ver"], p["hi"], p["lo"], F.col("_n"))).drop("_n")


def covering(rows: DataFrame, table: DataFrame, strict: bool = False, column: str = "prefix", on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of `rows` and the entries (`prefix`, ...) of `table` that cover them; the entry comes as struct `cover`.

    Entries must also agree with the row in the columns `on`.  Probes repeat, so each distinct one is looked up once.
    """
    met = _lookups(rows, table, strict, column, on)
    return rows.withColumn("_o", key(F.col(column))).join(met, ["_o", *on]).drop("_o")


def _lookups(rows: DataFrame, table: DataFrame, strict: bool, column: str, on: tuple[str, ...] = ()) -> DataFrame:
    """(_o, on, cover) for the key of each distinct probe."""
    own = rows.select(F.col(column).alias("_p"), *on).where("_p is not null").distinct()
    up = ancestors(own, lengths(table), "_p", strict).withColumn("_k", key(F.col("ancestor")))
    entries = table.select(key(F.col("prefix")).alias("_k"), *on, F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("cover"))
    return up.join(entries, ["_k", *on]).select(key(F.col("_p")).alias("_o"), *on, "cover")


def _nearest(rows: DataFrame, table: DataFrame, by: list[str], strict: bool, column: str = "prefix") -> DataFrame:
    best = _lookups(rows, table, strict, column).groupBy("_o").agg(F.max_by("cover", F.col("cover.prefix.len")).alias("cover"))
    return rows.select(*by, key(F.col(column)).alias("_o")).join(best, "_o").select(*by, "cover")


def exact(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.withColumn("_k", key(F.col("prefix"))).join(table.select(key(F.col("prefix")).alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def less_specifics(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Strict ancestors of each row in the table, nearest first by `cover.prefix.len`."""
    return covering(rows, table, strict=True)


def more_specifics(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Strict descendants of each row in the table, as struct `inner`; the table side is exploded."""
    at = lengths(rows)
    inner = table.select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("inner")).withColumn("_p", F.col("inner.prefix"))
    up = ancestors(inner, at, "_p", strict=True).select("inner", key(F.col("ancestor")).alias("_k"))
    return rows.withColumn("_k", key(F.col("prefix"))).join(up, "_k").drop("_k")


def min_covering(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """The nearest strict ancestor: `by` columns, which name a row, and `cover`."""
    return _nearest(rows, table, by, True)


def longest_match(rows: DataFrame, table: DataFrame, by: list[str], column: str = "prefix") -> DataFrame:
    """The longest entry that covers each row, itself included: `by` columns, which name a row, and `cover`."""
    return _nearest(rows, table, by, False, column)


def minimum_coverage(table: DataFrame) -> DataFrame:
    """The distinct prefixes that no other prefix of the table covers."""
    own = table.select("prefix").distinct()
    inner = ancestors(own, lengths(own), strict=True).select(F.col("prefix"), key(F.col("ancestor")).alias("_k"))
    covered = inner.join(own.select(key(F.col("prefix")).alias("_k")), "_k", "left_semi").select(key(F.col("prefix")).alias("_k")).distinct()
    return own.withColumn("_k", key(F.col("prefix"))).join(covered, "_k", "left_anti").drop("_k")


def overlap_mask(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """`by` columns and `mask`: the sum of LESS, EXACT and MORE as the table has such prefixes.

    A bit needs one witness, so distinct keys meet in semi-joins and no pairs are made.
    """
    entry = table.select("prefix").where("prefix is not null").distinct()
    own = rows.select("prefix").where("prefix is not null").distinct()
    named, known = own.select("prefix", key(F.col("prefix")).alias("_k")), entry.select(key(F.col("prefix")).alias("_k"))
    up = ancestors(own, lengths(entry), strict=True).select(key(F.col("prefix")).alias("_o"), key(F.col("ancestor")).alias("_k"))
    below = ancestors(entry, lengths(own), strict=True).select(key(F.col("ancestor")).alias("_k")).distinct()
    above = up.join(known, "_k", "left_semi").select(F.col("_o").alias("_k"), F.lit(LESS).alias("bit"))
    same = named.join(known, "_k", "left_semi").select("_k", F.lit(EXACT).alias("bit"))
    more = named.join(below, "_k", "left_semi").select("_k", F.lit(MORE).alias("bit"))
    bits = above.union(same).union(more).groupBy("_k").agg(F.bit_or("bit").alias("mask"))
    probes = rows.select(*by, key(F.col("prefix")).alias("_k")).distinct()
    return probes.join(bits, "_k", "left").groupBy(*by).agg(F.bit_or(F.coalesce("mask", F.lit(0))).alias("mask"))


def matching(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows that some (specificity, prefix) of `wanted` takes; a semi-join, so each row comes once."""
    down = wanted.where(F.col("specificity").isin("more", "any")).select("prefix")
    same = wanted.where(F.col("specificity") == "exact").select("prefix")
    up = wanted.where(F.col("specificity").isin("less", "any")).select("prefix")
    own = rows.select("prefix").where("prefix is not null").distinct()
    hits = covering(own, down).select("prefix").union(exact(own, same).select("prefix"))
    above = ancestors(up, lengths(own)).select(key(F.col("ancestor")).alias("_k")).distinct()
    hits = hits.union(own.withColumn("_k", key(F.col("prefix"))).join(above, "_k", "left_semi").select("prefix"))
    taken = hits.select(key(F.col("prefix")).alias("_k")).distinct()
    return rows.withColumn("_k", key(F.col("prefix"))).join(taken, "_k", "left_semi").drop("_k")


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("prefix").union(right.select("prefix")).distinct()


def remove(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.withColumn("_k", key(F.col("prefix"))).join(gone.select(key(F.col("prefix")).alias("_k")), "_k", "left_anti").drop("_k")


def walk(table: DataFrame) -> DataFrame:
    """Distinct prefixes in trie order: a prefix before those below it."""
    unsigned = lambda c: F.col("prefix")[c].bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return table.select("prefix").distinct().orderBy(F.col("prefix.ver"), unsigned("hi"), unsigned("lo"), F.col("prefix.len"))


def counts(table: DataFrame) -> DataFrame:
    """(ver, prefixes): distinct prefixes of each version."""
    return table.select("prefix").distinct().groupBy(F.col("prefix.ver").alias("ver")).agg(F.count("*").alias("prefixes"))


def count_24(table: DataFrame) -> DataFrame:
    """The number of /24 networks that the IPv4 prefixes touch."""
    v4 = table.select("prefix").where("prefix.ver = 4").distinct()
    outer = ip.v4_prefix(F.col("prefix.lo"), F.least(F.col("prefix.len"), F.lit(24)))
    lo, hi = ip.v4_range(outer)
    return union_v4(v4.select(lo.alias("lo"), hi.alias("hi"))).agg(F.coalesce(F.sum(F.expr("(hi - lo + 1) div 256")), F.lit(0)).alias("n_24"))


def _two_to(n: Column) -> Column:
    """2 to the power of 0 to 64, exactly; doubles round from 2**53 on when they become decimals."""
    return F.get(F.array(*[F.lit(str(1 << k)) for k in range(65)]), n).cast("decimal(38,0)")


def count_64(table: DataFrame) -> DataFrame:
    """The number of /64 networks that the IPv6 prefixes touch: maximal prefixes count by their size, longer ones by their /64."""
    v6 = table.select("prefix").where("prefix.ver = 6").distinct()
    cut = F.struct(F.col("prefix.ver").alias("ver"), F.col("prefix.hi").alias("hi"), F.when(F.col("prefix.len") >= 64, F.lit(0)).otherwise(F.col("prefix.lo")).cast("long").alias("lo"), F.least("prefix.len", F.lit(64)).alias("len"))
    top = minimum_coverage(v6.select(cut.alias("prefix")))
    return top.agg(F.coalesce(F.sum(_two_to(F.lit(64) - F.col("prefix.len"))), F.lit(0)).alias("n_64"))


def ranked_covers(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Strict ancestors with their rank, 1 for the nearest; a prefix has at most 128 of them."""
    order = Window.partitionBy(*by).orderBy(F.col("cover.prefix.len").desc())
    return less_specifics(rows, table).withColumn("rank", F.row_number().over(order))


def _sizes(prefix: Column) -> tuple[Column, Column]:
    """The size of an IPv6 prefix: in /64 networks, or in addresses where it is smaller than one."""
    zero = F.lit(0).cast("decimal(38,0)")
    return F.when(prefix["len"] <= 64, _two_to(64 - prefix["len"])).otherwise(zero), F.when(prefix["len"] > 64, _two_to(128 - prefix["len"])).otherwise(zero)


def _added(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("decimal(38,0)")


def union_v6(table: DataFrame) -> DataFrame:
    """The union of the IPv6 prefixes: prefixes nest or are apart, so these are the ones that no other covers."""
    return minimum_coverage(table.select("prefix").where("prefix.ver = 6"))


def unique_v6(table: DataFrame) -> DataFrame:
    """(n_64, n_rest): the union in whole /64 networks, and the addresses of the smaller prefixes outside of these."""
    nets, rest = _sizes(F.col("prefix"))
    return union_v6(table).agg(_added(nets).alias("n_64"), _added(rest).alias("n_rest"))


def overlap_v6(rows: DataFrame, counted: DataFrame, by: list[str]) -> DataFrame:
    """`by` columns, which name a row, n_64 and n_rest of the row's IPv6 prefix that `counted` has, and whether it has all of it."""
    top = union_v6(counted)
    own = rows.select("prefix").where("prefix.ver = 6").distinct()
    whole = covering(own, top).select("prefix", F.col("prefix").alias("part"), F.lit(True).alias("covered"))
    inside = more_specifics(own, top).select("prefix", F.col("inner.prefix").alias("part"), F.lit(False).alias("covered"))
    nets, rest = _sizes(F.col("part"))
    found = whole.union(inside).groupBy(key(F.col("prefix")).alias("_k")).agg(_added(nets).alias("n_64"), _added(rest).alias("n_rest"), F.bool_or("covered").alias("covered"))
    probes = rows.where("prefix.ver = 6").select(*by, key(F.col("prefix")).alias("_k")).join(found, "_k", "left")
    none = F.lit(0).cast("decimal(38,0)")
    return probes.select(*by, F.coalesce("n_64", none).alias("n_64"), F.coalesce("n_rest", none).alias("n_rest"), F.coalesce("covered", F.lit(False)).alias("covered"))


def walk_up_down(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """`by` columns, `prefix` and `relation` (exact, parent, child): the table's prefixes on the way up from and below each row."""
    entry = table.select("prefix").distinct()
    same = exact(rows, entry).select(*by, "prefix", F.lit("exact").alias("relation"))
    up = less_specifics(rows, entry).select(*by, F.col("cover.prefix").alias("prefix"), F.lit("parent").alias("relation"))
    down = more_specifics(rows, entry).select(*by, F.col("inner.prefix").alias("prefix"), F.lit("child").alias("relation"))
    return same.union(up).union(down)
