"""Running totals over parts against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from voidframe.plans.order import in_parts, ranked, running


def test_running_over_parts(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.randrange(1, 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, o int, v long").withColumn("k", F.struct("g"))
    cut = in_parts(df, "g", "o", parts=7)
    assert cut.where("g = 1").select("part").distinct().count() > 1
    got = running(cut, ["k"], ["o"], {"s": ("sum", F.col("v")), "x": ("xor", F.xxhash64("v"))}, whole=True).withColumn("h", F.xxhash64("v")).collect()
    by, total = defaultdict(list), defaultdict(int)
    for r in got:
        by[r.g].append(r)
        total[r.g] += r.v
    assert len(got) == len(rows)
    for g, own in by.items():
        s = x = 0
        for r in sorted(own, key=lambda r: r.o):
            assert (r.s, r.x, r.s_all) == (s, x, total[g])
            s, x = s + r.v, x ^ r.h


def test_ranks(spark):
    df = spark.range(1000).selectExpr("id % 2 g", "(id * 37) % 1000 o")
    for g in (0, 1):
        own = sorted((r.o, r.at) for r in ranked(df, ["g"], ["o"]).where(F.col("g") == g).collect())
        assert [at for _, at in own] == list(range(500))
