"""Import matching and attribution ranks: same rows as plain Python, little that is exchanged."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from causeway.operators import joins, models


def test_commits_take_only_keys_that_the_other_side_has(spark):
    rng = random.Random(4)
    names = ["utils", "lib.utils", "lib.ring.bolt", "nut", "a.very.long.module.name.that.fits.nothing", "src.lib.ring.bolt"]
    paths = ["src/lib/utils.py", "lib/ring/bolt.py", "src/nut.py", "src/other/thing.py"]
    imports = [(rng.randrange(40), f"t{rng.randrange(9)}", rng.choice(names)) for _ in range(300)]
    files = [(rng.randrange(40), rng.choice(paths)) for _ in range(90)]

    def fits(module, path):
        dotted = path[:-3].replace("/", ".")
        return dotted.split(".")[-1] in module.split(".") or module.endswith(dotted) or dotted.endswith(module)

    found = joins.direct_import(
        spark.createDataFrame(imports, "commit int, test string, module string"),
        spark.createDataFrame(files, "commit int, path string"), "test", "module", "path", ["commit"])
    assert {tuple(r) for r in found.collect()} == {
        (c, t, p) for c, t, m in imports for d, p in files if c == d and fits(m, p)}
    assert not cut_with_commits(found)


def cut_with_commits(df):
    """Plan lines of rows with their commit that are multiplied by the parts of a name."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [below for line, below in zip(lines, lines[1:])
            if "Generate explode" in line and "sequence" in line and "commit" in below]


def test_containment_cuts_distinct_names(spark):
    rng = random.Random(8)
    needles = [(rng.randrange(9), rng.choice(["", "a", "bolt", "ring", "gear_box", None])) for _ in range(40)]
    hays = [(rng.randrange(9), rng.choice(["ring_bolt", "gear_box_test", "xa", "", None, "bo"])) for _ in range(60)]
    found = joins.containments(spark.createDataFrame(needles, "commit int, n string"),
                               spark.createDataFrame(hays, "commit int, h string"), ["commit"], "n", "h")
    assert sorted(map(tuple, found.collect())) == sorted(
        {(c, n, h) for c, n in needles for d, h in hays if c == d and None not in (n, h) and n in h})
    assert not cut_with_commits(found)


def test_attribution_ranks_are_limited_before_the_exchange(spark):
    rng = random.Random(6)
    rows = [(f"r{i % 30}", f"f{j:03d}", float(rng.randrange(-5, 6))) for i in range(30) for j in range(80)]
    found = models.attribution_topk(spark.createDataFrame(rows, "row_id string, feature string, attribution double"),
                                    "row_id", 3)
    wanted = set()
    for row in {r[0] for r in rows}:
        for up in (True, False):
            own = sorted((-abs(a), f, a) for r, f, a in rows if r == row and a and (a > 0) == up)
            wanted |= {(row, f, a, k + 1) for k, (_, f, a) in enumerate(own[:3])}
    assert {(r.row_id, r.feature, r.attribution, r["rank"]) for r in found.collect()} == wanted
    assert dict(found.dtypes)["rank"] == "bigint"
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()
    beyond = models.attribution_topk(spark.createDataFrame(rows, "row_id string, feature string, attribution double"),
                                     "row_id", 2000)
    assert beyond.count() == sum(a != 0 for _, _, a in rows) and beyond.filter(F.col("rank") > 80).count() == 0
