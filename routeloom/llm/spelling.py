"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found in a reduced alphabet.

Letters are dealt to `SYMBOLS` symbols, the most frequent first, each to the symbol with the least so far, so that the symbols are about equally frequent
(counts over the whole vocabulary; the driver sees one row a letter).  One edit of a word is at most one edit of its
reduced form, so a word's near words are among those whose reduced form is in the one-edit neighbourhood of its own.
The relation is symmetric, so of two words the one with the longer reduced form, of equal lengths the one with the lower one, generates: it
generates its form, all deletions and all upward replacements, which meet every insertion and downward replacement of the other.  Keys are
64-bit hashes of reduced forms; each pair that meets is verified on the original strings, so chance equalities do no harm.

A reduced form of more than `crowd` words would make a number of pairs that grows with its square.  Words of such forms meet all others by
the words that remain when one letter is left out instead, with the place of that letter where both are equally long: there a word meets at most
the letters of the alphabet, so their work is linear.

Defined results: null and empty texts have no words; repeated rows count again; a null doc_id spells as the empty text in the checksum; an empty table
gives no rows.  Of near words with equal counts the first in code-point order is the form.  Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

SYMBOLS = "012345"
CROWD = 2000
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
#: The letters of the contract.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters in lower case, one letter deleted where the checksum of id and run is a multiple of 31, of so many letters and occurrences at least.

    Runs shorter than `letters` stay too short, so they are not even extracted.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{letters},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    found = found.select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    sums = found.select("_run", F.crc32(F.concat_ws(":", "_id", "_run")).alias("_h"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    words = sums.select(F.when(F.col("_h") % 31 == 0, cut).otherwise(F.col("_run")).alias("word"))
    return words.where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def symbols(words: DataFrame) -> tuple[str, str]:
    """The letters of the vocabulary and the symbol of each."""
    counts = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    load = dict.fromkeys(SYMBOLS, 0)
    letters, dealt = [], []
    for letter, n in sorted(counts.collect(), key=lambda r: (-r[1], r[0])):  # one row a letter
        symbol = min(load, key=lambda s: (load[s], s))
        load[symbol] += n
        letters.append(letter)
        dealt.append(symbol)
    return "".join(letters), "".join(dealt)


def _without(form: Column, i: Column) -> Column:
    return F.concat(F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, F.char_length(form)))


def neighbourhood(form: Column) -> Column:
    """Keys of a reduced form: itself, its deletions and its upward replacements."""
    places = F.sequence(F.lit(1), F.char_length(form))
    deleted = F.transform(places, lambda i: _without(form, i))

    def raised(i: Column) -> Column:
        higher = F.filter(F.array(*map(F.lit, SYMBOLS)), lambda s: s > F.substring(form, i, F.lit(1)))
        return F.transform(higher, lambda s: F.concat(F.substring(form, F.lit(1), i - 1), s, F.substring(form, i + 1, F.char_length(form))))

    return F.array_distinct(F.concat(F.array(form), deleted, F.flatten(F.transform(places, raised))))


ONE_EDIT = "levenshtein(a.word, b.word, 1) = 1"


def _remainders(words: DataFrame) -> DataFrame:
    """(key, whole, word, n): the word itself, and what remains without each letter, once with its place and once without."""
    places = F.sequence(F.lit(1), F.char_length("word"))
    held = F.transform(places, lambda i: F.struct(F.concat(i.cast("string"), F.lit(":"), _without(F.col("word"), i)).alias("key"), F.lit(False).alias("whole")))
    loose = F.array_distinct(F.transform(places, lambda i: F.struct(F.concat(F.lit(":"), _without(F.col("word"), i)).alias("key"), F.lit(False).alias("whole"))))
    own = F.array(F.struct(F.concat(F.lit(":"), F.col("word")).alias("key"), F.lit(True).alias("whole")))
    return words.select("word", "n", F.explode(F.concat(own, held, loose)).alias("_k")).select("_k.key", "_k.whole", "word", "n")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, n, near, near_n): every pair of words one edit apart, once."""
    letters, dealt = symbols(words)
    reduced = words.select("word", "n", F.translate("word", letters, dealt).alias("form")) if letters else words.select("word", "n", F.col("word").alias("form"))
    crowded = stash(reduced.groupBy("form").count().where(F.col("count") > crowd).select("form"), "spelling-crowds")
    sparse = reduced
    pairs = []
    if not crowded.isEmpty():
        sparse = reduced.join(crowded, "form", "left_anti")
        close = reduced.join(crowded, "form", "left_semi")
        mine = _remainders(close).alias("a")
        others = _remainders(reduced.join(crowded.withColumn("_crowded", F.lit(True)), "form", "left").select("word", F.struct("n", F.coalesce("_crowded", F.lit(False)).alias("crowded")).alias("n"))).alias("b")
        once = F.expr("(not b.n.crowded or a.word < b.word) and (substr(a.key, 1, 1) <> ':' or a.whole <> b.whole) and " + ONE_EDIT)
        pairs.append(mine.join(others, (F.col("a.key") == F.col("b.key")) & once).select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n.n").alias("near_n")).distinct())
    made = sparse.select("word", "n", "form", F.explode(neighbourhood(F.col("form"))).alias("_k")).select("word", "n", F.xxhash64("_k").alias("key"), (F.col("_k") == F.col("form")).alias("own")).alias("a")
    met = sparse.select("word", "n", F.xxhash64("form").alias("key")).alias("b")
    once = F.expr("(not a.own or a.word < b.word) and " + ONE_EDIT)
    pairs.append(made.join(met.hint("shuffle_hash"), (F.col("a.key") == F.col("b.key")) & once).select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n")))
    return pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])


def group_variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its most frequent near word if `ratio` times as frequent, and the last word that forms lead to."""
    words = stash(words, "spelling-words")
    pairs = near_pairs(words, crowd)
    sides = F.array(F.struct("word", "n", F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")).alias("best")), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")).alias("best")))
    near = pairs.select(F.explode(sides).alias("_s")).select("_s.*")
    alone = words.select("word", "n", F.lit(None).cast("struct<less:bigint,word:string>").alias("best"))
    best = near.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    formed = stash(best.select("word", F.when(has, F.col("best.word")).alias("form"), "n", "n_near", F.when(has, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = _roots(formed.where("form is not null").select("word", F.col("form").alias("root")), formed.agg(F.max("n")).first()[0] or 1, ratio)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root) by pointer doubling; each step multiplies the count by `ratio`, which bounds the rounds by the logarithm of a logarithm."""
    steps = math.ceil(math.log(most, ratio)) + 1
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        links = stash(links, "spelling-links")
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return links
