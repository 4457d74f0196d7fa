"""No cap drops what lies beyond a usual number of values, columns or levels."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from folioscope.operators import augment as A, cells as C, layout as L, service as S


def test_average_of_a_long_history(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(65)]
    rows = [("g", i // 10, i, v) for i, v in enumerate(values)] + [("h", 0, 0, 0.25), (None, 0, 0, 0.5)]
    want = values[0]
    for v in values[1:]:
        want = want * 0.98 + v * 0.02  # the 65th value back still counts
    got = {r.g: r.ema for r in A.smoothed_rates(spark.createDataFrame(rows, "g string, page int, at int, v double"), "g", ["page", "at"], "v", 0.02).collect()}
    assert abs(got["g"] - want) < 1e-6 and got["h"] == 0.25 and got[None] == 0.5


def test_headings_of_any_level(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for doc in "ab":
        stack = []
        for i in range(80):
            level = rng.choice([1, 2, 2, 3, 4, 5])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, f"{doc}{i}"))
            rows.append((doc, i, level, f"{doc}{i}"))
            want[f"{doc}{i}"] = [n for _, n in stack]
    df = spark.createDataFrame(rows, "doc string, at int, level int, name string")
    assert {r.name: r.path for r in L.heading_paths(df, ["doc"], ["at"], "level", "name").collect()} == want
    assert L.heading_paths(df.limit(0), ["doc"], ["at"], "level", "name").count() == 0


def test_newest_delivery_reads_only_what_is_used(spark, tmp_path):
    rows = [(1, "old", "x", None), (1, "new", None, 5), (2, "a", "b", 1)]
    df = spark.createDataFrame(rows, "cell_id bigint, text string, header string, at int").withColumn("loaded_at", F.timestamp_seconds("at"))
    assert {tuple(r) for r in C.delivered_once(df).select("cell_id", "text", "header").collect()} == {(1, "new", None), (2, "a", "b")}
    df.write.parquet(str(tmp_path / "t"))
    plan = C.delivered_once(spark.read.parquet(str(tmp_path / "t"))).select("text")._jdf.queryExecution().executedPlan().toString()
    assert "header" not in plan and "text" in plan


def test_nearest_rank_of_a_large_group(spark):
    rng = random.Random(3)
    values = {"a": [rng.random() for _ in range(3000)], "b": [1.0] * 50, "c": [7.0]}
    got = {r.g: r for r in S.latency(spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double"), "g", "v").collect()}
    for g, vs in values.items():
        vs = sorted(vs)
        assert (got[g].n, got[g].p50, got[g].p95) == (len(vs), vs[int(0.5 * (len(vs) - 1))], vs[int(0.95 * (len(vs) - 1))])
