"""Water-filling against exact arithmetic, sources that clamp together, and both ways to join the edges."""

import random
from fractions import Fraction

import pytest

from routeloom.llm import common, mixing


def filled(sizes, weights, budget, cap):
    """Targets by rounds, in exact numbers."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(names)}
    clamped, total = set(), sum(sizes.values()) * Fraction(budget)
    while True:
        left = [s for s in names if s not in clamped]
        if not left:
            return {s: Fraction(cap) * sizes[s] for s in names}
        level = (total - sum(Fraction(cap) * sizes[s] for s in clamped)) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: Fraction(cap) * sizes[s] if s in clamped else level * weight[s] for s in names}
        clamped |= over


@pytest.mark.parametrize("case", range(7))
def test_targets_are_those_of_the_rounds(spark, case):
    rng = random.Random(case)
    sizes = {f"s{k:03d}": rng.choice([0, 1, 7, 50, 1000, 10**6]) for k in range((1, 3, 5, 40, 200, 2, 9)[case])}
    if case == 5:
        sizes = {"a": 100, None: 10**6}
    if case == 6:  # sources of one size reach their clamp together
        sizes = {**{f"t{k}": 10 for k in range(9)}, "z": 10**5}
    weights, budget, cap = ((3, 1, 2), 1.5, 2.0) if case != 4 else ((1,), 5.0, 2.0)  # at last more is asked for than the clamps allow
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(4)
    got = {r.source: r.target for r in mixing.source_targets(table, weights, budget, cap).collect()}
    expected = filled(sizes, weights, budget, cap)
    assert set(got) == set(expected) and all(abs(got[s] - float(expected[s])) < 1e-6 * max(1, float(expected[s])) for s in got)


def test_edges_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 80])), rng.choice(["hot", "hot", "hot", "b", "c", None])) for k in range(400)]
    docs = spark.createDataFrame([*rows, rows[3], (None, "w w", "hot")], "doc_id long, text string, source string").repartition(3)
    some = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == some and len(some) == 402


@pytest.mark.parametrize("share", [1, 2, 1000])
def test_hot_keys_by_broadcast_and_the_rest_by_shuffle(spark, share):
    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 50}") for k in range(500)], "id int, key string").repartition(5)
    side = rows.groupBy("key").count().withColumnRenamed("count", "n")
    got = common.hot_join(rows, side.where("key <> 'k4'"), ["key"], "n", share).collect()
    by = {r.key: r.n for r in side.collect()}
    assert len(got) == 500 - by["k4"] and all(r.n == by[r.key] for r in got)
