from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.operators import units

SCHEMA = "measure_id bigint, source string, lang string, quantity_kind string, qty double, unit string, amount string, text string, loaded_at timestamp, label int, word string, kind string"
SOURCES = [("a", "mass", "lb"), ("a", "money", "thousand yen")]

CASES = [
    ("mass", "en", 2.0, "kg", None, "", 2000), ("mass", "en", None, None, None, "mass: 5 lb 3 oz", 2353), ("mass", "en", 3.0, None, None, "bolt AB-12", 1361),
    ("mass", "fr", None, None, None, "poids net: 2,32t (RF-979)", 2_320_000), ("mass", "ja", None, None, None, "正味重量 114ｇ, lot 87", 114), ("mass", "en", None, "kg", None, "width: ?", None),
    ("length", "en", None, None, None, "bore: 7'4\"", 2235), ("length", "ja", None, None, None, "全長: １．９ インチ (AC-810 軸受箱)", 48), ("length", "en", 33.8, None, None, "height[ft] plate", 10302),
    ("length", "en", 1.5, None, None, "hex bolt", None), ("volume", "en", None, None, None, "volume 2 1/2 m^3, tank AP-160", 2_500_000), ("volume", "fr", None, None, None, "capacité: 1,05 L", 1050),
    ("duration", "ja", None, None, None, "作業時間 1時間25分", 5100), ("duration", "fr", None, None, None, "durée: 6 h 25", 23100), ("pressure", "ja", None, None, None, "使用圧力 15.1kgf/cm2, lot 58", 1481),
    ("temperature", "en", None, None, None, "operating temperature -12 C, lot 56", -12), ("temperature", "en", 266.0, "K", None, "", -7), ("temperature", "ja", 50.0, None, None, "温度[華氏度] 台", 10),
    ("count", "fr", None, None, None, "qté livrée=3,0 mille pièces", 3000), ("count", "ja", 3.0, "打", None, None, 36), ("money", "en", None, None, "3660.1k yen", "filter", 3_660_100),
    ("money", "fr", None, None, "JPY 66 424", "x", 66424), ("money", "ja", None, None, "２．７ 萬円", "x", 27000), ("money", "en", None, None, None, "amount MJPY 6.4, lot 63", 6_400_000),
    ("money", "ja", None, None, "5.8", "軸受箱", 5800), ("money", "ja", None, None, "¥54,348", None, 54348), ("nothing", "en", 1.0, "kg", None, "1 kg", None), (None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def converted(spark):
    rows = [(i, "a", lang, kind, qty, unit, amount, text, None, 7, "clash", "clash") for i, (kind, lang, qty, unit, amount, text, _) in enumerate(CASES)]
    # enough of either kind for the classifier to learn from
    rows += [(1000 + i, "a", "en", "mass", 1.0 + i, None, None, "bolt", None, 7, "clash", "clash") for i in range(30)]
    rows += [(2000 + i, "a", "en", "length", 1.0 + i, "mm", None, "bolt", None, 7, "clash", "clash") for i in range(30)]
    m = spark.createDataFrame(rows + rows[:5], SCHEMA)
    return {r.measure_id: r for r in units.units_found(m, spark.createDataFrame(SOURCES, "source string, quantity_kind string, default_unit string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_value(converted, i):
    want = CASES[i][-1]
    got = converted.get(i)
    assert (got.common_value if got else None) == want
    if got:
        assert got.common_unit == units.COMMON[CASES[i][0]]


def test_declared_rows_all_found(converted):
    assert all(converted[1000 + i].common_value == round((1 + i) * 453.59237) for i in range(30))


def test_empty(spark):
    m = spark.createDataFrame([], SCHEMA)
    s = spark.createDataFrame([], "source string, quantity_kind string, default_unit string")
    assert units.units_found(m, s).count() == 0


def _silent_rows(unit_of, n=100, known=90, source="z"):
    return [(i, source, "en", "volume", float(i % 7 + 1), unit_of(i) if i < known else None, None, None, None, 0, "", "") for i in range(n)]


def test_uncertain_goes_to_review(spark):
    rows = _silent_rows(lambda i: ("ml", "l", "m3")[i % 3])
    m, s = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("q", "mass", "kg")], "source string, quantity_kind string, default_unit string")
    n = {r.origin: r.n for r in units.convert(m, s).groupBy("origin").agg(F.count("*").alias("n")).collect()}
    assert n["stated"] == 90 and n.get("review", 0) + n.get("predicted", 0) == 10 and n.get("review", 0) > 0
    assert units.review(m, s).count() == 10
    assert units.units_found(m, s).count() == 90  # nothing declared: the unit can't be told


def test_the_forest_decides(spark):
    """Without forest the declaration would convert these rows to litres."""
    rows = [(i, "z", "en", "volume", float(i % 7 + 1), None, None, None, None, 0, "", "") for i in range(200)]
    rows += [(1000 + i, "y", "en", "volume", float(i % 7 + 1), "ml", None, None, None, 0, "", "") for i in range(200)]
    m = spark.createDataFrame(rows, SCHEMA)
    s = spark.createDataFrame([("z", "volume", "l")], "source string, quantity_kind string, default_unit string")
    c = {(r.origin, r.declares): r.n for r in units.convert(m, s).groupBy("origin", "declares").agg(F.count("*").alias("n")).collect()}
    assert c == {("predicted", True): 200, ("stated", False): 200}
    without = units.convert(m, s, training_rows=0)
    assert {r.origin for r in without.collect()} == {"stated", "declared"}


def test_held_out_accuracy(spark, sf):
    """Units hidden: what is believed is right, and probabilities mean what they say."""
    d = sf.rsplit("/", 1)[0] + "/sf0.01"
    r = units.held_out_accuracy(spark.read.parquet(f"{d}/measures.parquet"), spark.read.parquet(f"{d}/source_units.parquet")).collect()
    sure = sum(x.n_confident for x in r)
    assert sure > 50 and sum(x.n_confident * (x.confident_accuracy or 0) for x in r) / sure >= 0.9
    assert sum(x.n * x.calibration_error for x in r) / sum(x.n for x in r) < 0.15
    silent = [x for x in r if x.silent]
    assert sum(x.n * x.accuracy for x in silent) / sum(x.n for x in silent) >= 0.85
