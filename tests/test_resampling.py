"""Resampled sums against draws written out, and how little is exchanged for them."""

from __future__ import annotations

from collections import Counter

import pytest

from causeway.operators import statistics

P = statistics._PRIME


def plain_draw(seed, replicate, number, bound):
    cube = lambda x: x * x % P * x % P
    state = cube(seed % P)
    for added in (replicate, number // 65536, number % 65536, 12345):
        state = cube((state + added) % P)
    second = cube((cube((state + number % 65536 + 777) % P) + 12345) % P)
    return (state * P + second) % bound


@pytest.mark.parametrize("replicates, block", [(3, 4), (40, 7), (2, 512)])
def test_sums_equal_the_written_out_draws(spark, replicates, block):
    n = 301
    rows = spark.createDataFrame([(u, k, float(u * 10 + (k == "a"))) for u in range(n) for k in ("a", None)
                                  if k or u % 3], "u long, k string, v double")
    found, size = statistics.resampled_sums(rows, ["u"], ["k"], ["v"], replicates, 9, block)
    wanted = Counter()
    for rep in range(replicates):
        blocks = Counter(plain_draw(9, rep, i, n) // block for i in range(n))
        for b, times in blocks.items():
            for i in range(times):
                u = b * block + plain_draw(10 + b, rep, i, min(block, n - b * block))
                wanted[rep, "a"] += u * 10 + 1
                wanted[rep, None] += u * 10 if u % 3 else 0
    assert size == n and {(r.rep, r.k): r.v for r in found.collect()} == wanted


def test_blocks_are_exchanged_in_groups(spark):
    """Fifty thousand blocks come as one row per replicate and group, with every draw counted."""
    counted = statistics._block_counts(spark, 200_000, 5, 3, 4, 256).collect()
    assert len(counted) == 5 * -(-50_000 // 256)
    total = Counter()
    for r in counted:
        total[r.rep] += sum(memoryview(bytes(r["__counts"])).cast("i"))
    assert total == {i: 200_000 for i in range(5)}
