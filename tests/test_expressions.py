from __future__ import annotations

import importlib
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from folioscope.functions import values as V, words as W
from folioscope.operators import augment as A, cells as C, retrieval as R, service as S

ROOT = Path(__file__).resolve().parents[1]


def values(spark, make, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_amounts_and_dates(spark):
    assert values(spark, V.whole_amount, ["¥1,234.56", "x 12", "none", None, "1234567"]) == [1234, 12, None, None, 1234567]
    assert values(spark, V.iso_date, ["2024年3月5日", "2024/02/30", "due 2023-07", None, ""]) == ["2024-03-05", "2024-02-03", "2023-07-01", None, None]
    era = lambda c: A.era_date(c)["day"]
    assert values(spark, era, ["令和6年4月1日", "平成元年12月", "20240131", "2024/13/01", "昭和64年1月7日", None]) == ["2024-04-01", "1989-12", "2024-01-31", None, "1989-01-07", None]
    assert values(spark, A.signed_number, ["(1,234.50)", "２０％", "¥5", "1 234,50 €", "-3", "abc", None]) == [-1234.5, 0.2, 5.0, 1234.5, -3.0, None, None]


def test_tokens_and_signatures(spark):
    assert values(spark, W.plain_tokens, ["A-1, b_2 Ü x", None, ""]) == [["a-1", "b_2", "x"], [], []]
    assert values(spark, W.mixed_tokens, ["Acme 1,234.5 日本語", "日", None]) == [["acme", "1,234.5", "日本", "本語"], [], []]
    assert values(spark, V.type_signature, ["PN-01 55 mm", "xx yy", "", None]) == ["ID-NUM-UNIT", "TEXT", "", ""]
    assert values(spark, C.key_values, ["a=1 | b = x=y | c | a=2", ""]) == [{"b": "x=y", "a": "2"}, {}]


def test_header_match_and_penalty(spark):
    assert values(spark, lambda c: R.header_match(c, ["Unit price"], ["unit", "un"]), ["unit PRICE", "units", "x", None]) == [1.0, 1.0, 0.0, 0.0]


def test_bm25_matches_a_direct_count(spark):
    import math

    docs = [(1, "a b a"), (2, "b c"), (3, None), (4, "c")]
    df = spark.createDataFrame(docs, "id int, text string")
    got = {r.id: r.score for r in R.bm25(df, "id", W.plain_tokens(F.col("text")), ["a", "b", "a", "zz"]).collect()}
    tokens = {i: (t or "").split() for i, t in docs}
    avg = sum(map(len, tokens.values())) / 4
    want = {}
    for i, t in tokens.items():
        s = 0.0
        for q in ("a", "b", "a"):
            df_, tf = sum(q in x for x in tokens.values()), t.count(q)
            s += math.log((4 - df_ + 0.5) / (df_ + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if s:
            want[i] = s
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert R.bm25(df, "id", W.plain_tokens(F.col("text")), []).count() == 0


def test_latency_is_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 12)] + [("b", 5.0), ("b", None)], "g string, v double")
    got = {r.g: (r.n, r.p50, r.p95) for r in S.latency(df, "g", "v").collect()}
    assert got == {"a": (11, 6.0, 10.0), "b": (1, 5.0, 5.0)}


def test_registry():
    entry = importlib.import_module("__spark_entry__")
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 100
    assert {f"p{n}_found" for n in (3, 4)} <= set(queries)


def test_core_does_not_need_llm(tmp_path):
    """The library without its subpackage llm still imports and registers its queries."""
    import shutil

    shutil.copytree(ROOT / "folioscope", tmp_path / "folioscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('p1_') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "False"
