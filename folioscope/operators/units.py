"""Quantities in different units and scales brought to one unit per kind of quantity."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.marks import narrow
from folioscope.runtime import cut

#: Common unit of each kind.
COMMON = {
    "mass": "g", "length": "mm", "volume": "ml", "duration": "s", "pressure": "kPa", "temperature": "degC",
    "count": "piece", "money": "yen",
}

#: Exact definitions: (kind, unit, factor, offset) with common = value * factor + offset, and its spellings in lower case.
UNITS: list[tuple[str, str, float, float, str]] = [
    ("mass", "mg", 0.001, 0, "mg|㎎|milligram|milligrams|milligramme|milligrammes|ミリグラム"),
    ("mass", "g", 1, 0, "g|gr|gr.|gm|gram|grams|gramme|grammes|グラム"),
    ("mass", "kg", 1000, 0, "kg|kg.|kgs|kgs.|㎏|kilo|kilos|kilogram|kilograms|kilogramme|kilogrammes|キロ|キログラム"),
    ("mass", "t", 1e6, 0, "t|tonne|tonnes|metric ton|metric tons|tonnes métriques|tonne métrique|トン|㌧"),
    ("mass", "lb", 453.59237, 0, "lb|lb.|lbs|lbs.|pound|pounds|livre av.|livres av.|livre|livres|ポンド|㍀"),
    ("mass", "oz", 28.349523125, 0, "oz|oz.|ounce|ounces|once|onces|オンス"),
    ("length", "mm", 1, 0, "mm|㎜|millimeter|millimeters|millimetre|millimetres|millimètre|millimètres|ミリ|ミリメートル"),
    ("length", "cm", 10, 0, "cm|㎝|centimeter|centimeters|centimetre|centimetres|centimètre|centimètres|センチ|センチメートル"),
    ("length", "m", 1000, 0, "m|mtr|mtrs|meter|meters|metre|metres|mètre|mètres|メートル|㍍"),
    ("length", "km", 1e6, 0, "km|㎞|kilometer|kilometers|kilometre|kilometres|kilomètre|kilomètres|キロメートル"),
    ("length", "in", 25.4, 0, "in|in.|inch|inches|\"|″|”|''|pouce|pouces|インチ"),
    ("length", "ft", 304.8, 0, "ft|ft.|foot|feet|'|′|’|pied|pieds|フィート"),
    ("length", "yd", 914.4, 0, "yd|yds|yard|yards|ヤード"),
    ("volume", "ml", 1, 0, "ml|㎖|cc|㏄|milliliter|milliliters|millilitre|millilitres|ミリリットル|cm3|cm^3|cm³|㎤"),
    ("volume", "cl", 10, 0, "cl|centiliter|centiliters|centilitre|centilitres|センチリットル"),
    ("volume", "dl", 100, 0, "dl|㎗|deciliter|deciliters|decilitre|decilitres|décilitre|décilitres|デシリットル"),
    ("volume", "l", 1000, 0, "l|ℓ|lt|ltr|ltrs|liter|liters|litre|litres|リットル|リッター"),
    ("volume", "m3", 1e6, 0, "m3|m^3|m³|㎥|cu.m|cu. m|cu m|cu.m.|cubic meter|cubic meters|cubic metre|cubic metres|mètre cube|mètres cubes|立米|立方メートル|立法メートル"),
    ("volume", "gal", 3785.411784, 0, "gal|gal.|gallon|gallons|ガロン"),
    ("duration", "s", 1, 0, "s|s.|sec|sec.|secs|second|seconds|seconde|secondes|秒|秒間"),
    ("duration", "min", 60, 0, "min|min.|mins|mins.|minute|minutes|mn|分|分間"),
    ("duration", "h", 3600, 0, "h|h.|hr|hr.|hrs|hrs.|hour|hours|heure|heures|時間"),
    ("duration", "d", 86400, 0, "d|day|days|jour|jours|日|日間"),
    ("pressure", "Pa", 0.001, 0, "pa|pascal|pascals|パスカル"),
    ("pressure", "hPa", 0.1, 0, "hpa|hectopascal|hectopascals|ヘクトパスカル|㍱"),
    ("pressure", "kPa", 1, 0, "kpa|㎪|kilopascal|kilopascals|キロパスカル"),
    ("pressure", "MPa", 1000, 0, "mpa|㎫|megapascal|megapascals|mégapascal|mégapascals|メガパスカル"),
    ("pressure", "bar", 100, 0, "bar|bars|㍴|バール"),
    ("pressure", "kgf/cm2", 98.0665, 0, "kgf/cm2|kgf/cm^2|kgf/cm²|kgf/㎠|kg/cm2|kg/cm²|㎏/㎠|kg/㎠"),
    ("temperature", "degC", 1, 0, "c|°c|℃|degc|deg c|deg. c|degree c|degrees c|degré c|degrés c|celsius|degrees celsius|degrés celsius|度|摂氏|摂氏度|度c"),
    ("temperature", "degF", 5 / 9, -160 / 9, "f|°f|℉|degf|deg f|deg. f|degree f|degrees f|degré f|degrés f|fahrenheit|degrees fahrenheit|degrés fahrenheit|華氏|華氏度"),
    ("temperature", "K", 1, -273.15, "k|°k|kelvin|kelvins|ケルビン"),
    ("count", "piece", 1, 0, "pc|pc.|pcs|pcs.|piece|pieces|pièce|pièces|unit|units|unité|unités|ea|ea.|each|個|箇|枚|本|ヶ|ケ|コ|点|台"),
    ("count", "dozen", 12, 0, "dz|dz.|doz|doz.|dozen|dozens|douzaine|douzaines|ダース|打"),
    ("count", "thousand", 1000, 0, "kpcs|k pcs|k pc|thousand pcs|thousand pieces|thousand|millier|milliers|mille pièces|mille|milliers de pièces|千個|千枚|千本|仟個|仟枚"),
    ("money", "yen", 1, 0, "yen|yens|jpy|円|圓|¥"),
    ("money", "thousand yen", 1e3, 0, "thousand yen|thousands of yen|k yen|kyen|k¥|k jpy|kjpy|millier de yens|milliers de yens|千円|仟円"),
    ("money", "ten thousand yen", 1e4, 0, "ten thousand yen|10k yen|10k jpy|man yen|dizaine de milliers de yens|dizaines de milliers de yens|万円|萬円"),
    ("money", "million yen", 1e6, 0, "million yen|millions of yen|m yen|myen|m¥|m jpy|mjpy|million de yens|millions de yens|百万円"),
    ("money", "hundred million yen", 1e8, 0, "hundred million yen|億円"),
]

#: One label per (kind, unit), in the order of UNITS.
LABELS = [(kind, unit) for kind, unit, *_ in UNITS]

#: Rows the classifier is fitted on at most, its size, and the calibrated probability from which it is believed.
TRAINING_ROWS, TREES, DEPTH, CONFIDENT = 20_000, 20, 10, 0.9

_NUM = r"-?\d+(?:\.\d+)?(?: \d+/\d+)?"


def _spelled(kind: str, money_prefix: bool = False) -> str:
    """Alternatives of a kind's unit spellings, longest first; a Latin one ends where no letter follows."""
    words = sorted({w for k, _, _, _, s in UNITS if k == kind for w in s.split("|")}, key=lambda w: (-len(w), w))
    return "|".join(re.escape(w).replace("\\ ", " ?") + ("(?![a-zà-öø-ÿ])" if w[-1].isalpha() and w[-1] < "ɐ" else "") for w in words)


def _spellings(spark) -> DataFrame:
    """The fixed table of spellings ``(kind, word, label, factor, offset)``, spaces taken out; some hundred rows."""
    rows: dict[tuple[str, str], tuple[int, float, float]] = {}
    for i, (kind, _, factor, offset, spelled) in enumerate(UNITS):
        for w in spelled.split("|"):
            rows.setdefault((kind, w.replace(" ", "")), (i, float(factor), float(offset)))
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], "kind string, word string, label int, factor double, offset double")


def _with_unit(df: DataFrame, word: str, prefix: str = "") -> DataFrame:
    """Adds label, factor and offset of the unit spelled in column ``word`` for the row's kind; null when unknown."""
    s = F.broadcast(_spellings(df.sparkSession))
    found = s.select(F.col("kind").alias("k_"), F.col("word").alias("w_"), *(F.col(c).alias(prefix + c) for c in ("label", "factor", "offset")))
    spelled = F.regexp_replace(df[word], " ", "")
    return df.join(found, (df["quantity_kind"] == F.col("k_")) & (spelled == F.col("w_")), "left").drop("k_", "w_")


def _number(text: Column) -> Column:
    """``-12.5`` or ``4 1/5`` as a double; null when empty."""
    whole = F.regexp_extract(text, r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    top, bottom = (F.regexp_extract(text, r" (\d+)/(\d+)$", i).try_cast("double") for i in (1, 2))
    part = F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    return whole + F.when(text.startswith("-"), -part).otherwise(part)


def _plain(text: Column, lang: Column) -> Column:
    """Codes and lot numbers gone, digit groups closed up, decimal points only, lower case."""
    t = F.lower(narrow(text))
    t = F.regexp_replace(t, r"(?<![a-z0-9])[a-z]{1,4}-\d+(?![\d.])", "#")
    t = F.regexp_replace(F.regexp_replace(t, r"m\^?3(?!\d)", "m³"), r"cm\^?2(?!\d)", "cm²")
    t = F.regexp_replace(t, r"(?<![a-z])(?:lot|no\.?|n°|ref\.?)\s*\d+", "#")
    french = F.regexp_replace(F.regexp_replace(t, r"(?<=\d)[ .](?=\d{3}(?!\d))", ""), r"(?<=\d),(?=\d)", ".")
    return F.when(F.lower(lang).startswith("fr"), french).otherwise(F.regexp_replace(t, r"(?<=\d),(?=\d{3}(?!\d))", ""))


def _by_kind(kind: Column, make) -> Column:
    """``make(kind name)`` for the row's kind: every pattern stays a literal that is compiled once."""
    return reduce(lambda done, k: done.when(kind == k, make(k)), COMMON, F.when(F.lit(False), make("mass")))


def _stated(text: Column, kind: Column, only: str = "") -> Column:
    """First value of the kind with a unit beside it, as written; two adjoining parts are one value."""

    def make(k: str) -> Column:
        u = _spelled(k)
        after = rf"(?<![a-z\d.,/#-]){_NUM}\s*(?:{u})(?:\s*\d+(?:\.\d+)?(?![\d.,/])(?:\s*(?:{u}))?)?"
        return F.regexp_extract(text, after if k != "money" else rf"{after}|(?:{u})\s*{_NUM}", 0)

    return make(only) if only else _by_kind(kind, make)


def _parts(stated: Column, prefix: str) -> dict[str, Column]:
    """What ``_stated`` found as columns v1, u1, v2, u2 with the prefix; units hold no digits here."""
    before = F.regexp_extract(stated, r"^([^\d-]+?)\s*(-?\d.*)$", 1)
    after = [F.regexp_extract(stated, rf"^({_NUM})\s*([^\d]*?)\s*(?:(\d+(?:\.\d+)?)\s*([^\d]*))?$", i) for i in (1, 2, 3, 4)]
    v1 = F.when(before != "", F.regexp_extract(stated, rf"({_NUM})$", 1)).otherwise(after[0])
    u1 = F.when(before != "", before).otherwise(after[1])
    return {f"{prefix}v1": v1, f"{prefix}u1": u1, f"{prefix}v2": after[2], f"{prefix}u2": after[3]}


def _bracketed(text: Column, kind: Column) -> Column:
    """A unit that stands alone in brackets or after the word for unit."""

    def make(k: str) -> Column:
        u = _spelled(k)
        return F.regexp_extract(text, rf"(?:[(\[](?:単位|unit|units|unité)?\s*[:=]?\s*|単位\s*[:=]?\s*|in |en )({u})\s*(?:[)\]]|$)", 1)

    return _by_kind(kind, make)


def read_quantities(measures: DataFrame, source_units: DataFrame) -> DataFrame:
    """One row per measure: ``measure_id, quantity_kind, source, lang, value, label, common, declared, field_word``.

    ``value`` and ``label`` (index into LABELS) are what the record itself states, ``common`` the
    stated value in the common unit, ``declared`` the label of its source's default. Repeated
    deliveries count once (the newest). Unknown kinds give null values. Null ids are dropped.
    """
    fields = ["source", "lang", "quantity_kind", "qty", "unit", "amount", "text"]
    one = (
        measures.where(F.col("measure_id").isNotNull())
        .groupBy("measure_id")
        .agg(F.max(F.struct(F.col("loaded_at").alias("o"), *fields)).alias("r"))
        .select("measure_id", *(F.col(f"r.{f}").alias(f) for f in fields))
    )
    kind, money = F.col("quantity_kind"), F.col("quantity_kind") == "money"
    t = one.withColumn("t", _plain(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))))
    t = t.withColumn("m", F.when(money, _plain(F.coalesce("amount", F.lit("")), F.coalesce("lang", F.lit("")))).otherwise(F.lit("")))
    t = t.withColumns({"s_text": _stated(F.col("t"), kind), "s_amount": F.when(money, _stated(F.col("m"), kind, "money"))})
    t = t.withColumns(_parts(F.col("s_text"), "t_") | _parts(F.col("s_amount"), "a_"))
    t = t.withColumn("bracket", _bracketed(F.col("t"), kind)).withColumn("u", F.trim(_plain(F.coalesce("unit", F.lit("")), F.lit(""))))
    bare_amount = F.regexp_extract("m", r"(?<![a-z\d.,/#-])(-?\d+(?:\.\d+)?)", 1)
    bare_text = F.regexp_extract("t", rf"[:=]\s*({_NUM})(?![\w.,/])", 1)
    own = F.when(money, F.when(F.col("a_v1") != "", _number(F.col("a_v1"))).otherwise(_number(bare_amount))).otherwise(
        F.when(~F.isnan("qty"), F.col("qty"))
    )
    known = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names))
    # Beside a value of its own column stands the unit column or the amount's unit; beside a value in the text, the text's.
    t = t.withColumns({"own": own, "text_value": F.coalesce(_number(F.col("t_v1")), _number(bare_text))})
    t = t.withColumn("word", F.when(F.col("own").isNotNull(), known("u", "a_u1", "bracket", "t_u1")).otherwise(known("u", "t_u1", "bracket")))
    hours = F.col("t_u1").isin(*next(u[4] for u in UNITS if u[1] == "h").split("|"))
    t = t.withColumn("word2", F.coalesce(F.nullif(F.trim("t_u2"), F.lit("")), F.when(hours, F.lit("min"))))
    t = _with_unit(_with_unit(t, "word"), "word2", "second_")
    part = F.when(F.col("own").isNull() & (F.col("t_v2") != ""), _number(F.col("t_v2")) * F.col("second_factor") + F.col("second_offset"))
    t = t.withColumn("value", F.coalesce("own", "text_value"))
    t = t.withColumn("common", F.col("value") * F.col("factor") + F.col("offset") + F.coalesce(part, F.lit(0.0)))
    default = _with_unit(source_units.select("source", "quantity_kind", F.lower(narrow(F.col("default_unit"))).alias("d")), "d")
    default = default.groupBy("source", "quantity_kind").agg(F.min("label").alias("declared"))
    word = F.regexp_extract("t", r"([a-zà-öø-ÿ'぀-ヿ一-鿿]+)\s*[:=\[(]", 1)
    return t.join(default, ["source", "quantity_kind"], "left").select(
        "measure_id", "quantity_kind", "source", "lang", "value", "label", "common", "declared", word.alias("field_word")
    )


def _features(df: DataFrame) -> DataFrame:
    """Magnitude, source, kind, language, the word beside the value, and whether the source's default is meant, as a vector."""
    kinds = F.coalesce(*(F.when(F.col("quantity_kind") == k, F.lit(float(i))) for i, k in enumerate(COMMON)), F.lit(float(len(COMMON))))
    size = F.log10(F.abs("value") + F.lit(1e-6))
    fraction = (F.col("value") != F.floor("value")).cast("double")
    bucket = lambda c, n: (F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), F.lit(n))).cast("double")
    df = df.withColumns({
        "f_kind": kinds, "f_size": size, "f_fraction": fraction, "f_source": bucket("source", 4096), "f_lang": bucket("lang", 8),
        "f_word": bucket("field_word", 64), "f_silent": F.col("silent").cast("double"),
    })
    return VectorAssembler(inputCols=[c for c in df.columns if c.startswith("f_")], outputCol="features", handleInvalid="keep").transform(df)


#: A row states no unit and its source declares a default: such rows are an own population among those the forest learns from.
_SILENT = "label IS NULL AND declared IS NOT NULL"


def _fitted(quantities: DataFrame, training_rows: int) -> tuple[DataFrame, list, object] | None:
    """Held-out rows judged by the forest (``silent, quantity_kind, p, right``), the calibration curve of either population, and the forest."""
    known = quantities.where("value IS NOT NULL").withColumn("silent", F.expr(_SILENT)).withColumn("target", F.coalesce("label", "declared").cast("double")).where("target IS NOT NULL")
    h = F.pmod(F.xxhash64("measure_id", F.lit("fit")), F.lit(1 << 40))
    known = _features(known).withColumn("h", h).select("measure_id", "h", "silent", "quantity_kind", "target", "features")
    half = lambda which: known.where(which).orderBy("h", "measure_id").limit(training_rows // 2)
    sample = cut(half("silent").unionByName(half("NOT silent")))
    fit, held = sample.where(F.pmod("h", F.lit(5)) != 0), sample.where(F.pmod("h", F.lit(5)) == 0)
    if fit.isEmpty():
        return None
    forest = RandomForestClassifier(labelCol="target", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="all", seed=7, subsamplingRate=0.8).fit(fit)
    top = F.array_max(vector_to_array("probability"))
    judged = cut(forest.transform(held).select("silent", "quantity_kind", top.alias("p"), (F.col("prediction") == F.col("target")).cast("double").alias("right")))
    curves = []
    for which in (True, False):
        part = judged.where(F.col("silent") == which)
        curves.append(None if part.isEmpty() else IsotonicRegression(featuresCol="p", labelCol="right").fit(part))
    return judged, curves, forest


def assign_units(quantities: DataFrame, training_rows: int = TRAINING_ROWS, confident: float = CONFIDENT) -> DataFrame:
    """Predict the unit of every row that has a value but states no unit.

    A random forest is fitted on at most ``training_rows`` labelled rows (those with the smallest
    hash of their id), half of them rows that state their unit and half silent ones whose source
    declares a default; neither the declaration nor the stated unit is a feature. A fifth is kept out
    to calibrate the forest's top probability by isotonic regression, for either population by itself;
    a silent row without a declaration is judged like those that state their unit. Adds ``predicted``
    (label), ``probability`` (calibrated) and ``assigned`` (null below ``confident``). Without
    labelled rows to fit and to calibrate on, nothing is assigned.
    """
    missing = quantities.where("value IS NOT NULL AND label IS NULL").withColumn("silent", F.expr(_SILENT))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("predicted", "int"), ("probability", "double"), ("assigned", "int"))]
    fitted = _fitted(quantities, training_rows)
    if fitted is None:
        return missing.select(*quantities.columns, *none)
    _, curves, forest = fitted
    scored = forest.transform(_features(missing)).withColumn("p", F.array_max(vector_to_array("probability"))).drop("probability", "rawPrediction").withColumnRenamed("prediction", "best")
    parts = []
    for which, curve in zip((True, False), curves, strict=True):
        part = scored.where(F.col("silent") == which)
        sure = F.when(F.col("prediction") >= confident, F.col("best").cast("int"))
        parts.append(part.select(*quantities.columns, *none) if curve is None else curve.transform(part).select(*quantities.columns, F.col("best").cast("int").alias("predicted"), F.col("prediction").alias("probability"), sure.alias("assigned")))
    return parts[0].unionByName(parts[1])


def held_out_accuracy(measures: DataFrame, source_units: DataFrame, training_rows: int = TRAINING_ROWS, confident: float = CONFIDENT) -> DataFrame:
    """How the forest does on rows it wasn't fitted on, their units hidden.

    ``(quantity_kind, silent, n, accuracy, n_confident, confident_accuracy, calibration_error)`` per
    kind and population; the error is the mean distance of calibrated probability and outcome over
    fifths of the probability, weighted by rows.
    """
    fitted = _fitted(cut(read_quantities(measures, source_units)), training_rows)
    if fitted is None:
        return measures.sparkSession.createDataFrame([], "quantity_kind string, silent boolean, n bigint, accuracy double, n_confident bigint, confident_accuracy double, calibration_error double")
    judged, curves, _ = fitted
    parts = [c.transform(judged.where(F.col("silent") == which)) for which, c in zip((True, False), curves, strict=True) if c is not None]
    if not parts:
        parts = [judged.where("false").withColumn("prediction", F.lit(0.0))]
    scored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fifth = F.least(F.floor(F.col("prediction") * 5), F.lit(4))
    bins = scored.groupBy("quantity_kind", "silent", fifth.alias("fifth")).agg(
        F.count("*").alias("m"), F.sum("right").alias("r"), F.sum("prediction").alias("s"),
        F.count_if(F.col("prediction") >= confident).alias("c"), F.sum(F.when(F.col("prediction") >= confident, F.col("right"))).alias("cr"),
    )
    n = F.sum("m")
    return bins.groupBy("quantity_kind", "silent").agg(
        n.alias("n"), F.round(F.sum("r") / n, 4).alias("accuracy"), F.sum("c").alias("n_confident"),
        F.round(F.try_divide(F.sum("cr"), F.sum("c")), 4).alias("confident_accuracy"), F.round(F.sum(F.abs(F.col("r") - F.col("s"))) / n, 4).alias("calibration_error"),
    )


def convert(measures: DataFrame, source_units: DataFrame, training_rows: int = TRAINING_ROWS, confident: float = CONFIDENT) -> DataFrame:
    """Every measure with a value: ``measure_id, quantity_kind, common_unit, common_value, origin, probability, declares``.

    ``origin`` is ``stated``; ``predicted`` (no unit stated: the forest is confident, and its unit is
    taken); ``declared`` (the forest is uncertain; the review is settled by the source's default) or
    ``review`` (uncertain and nothing declared: no value). ``declares`` says whether the source
    declares a default for the kind.
    """
    q = cut(read_quantities(measures, source_units))  # read three times below: parse once
    declares = F.col("declared").isNotNull().alias("declares")
    stated = q.where("common IS NOT NULL").select("*", F.lit("stated").alias("origin"), F.lit(1.0).alias("probability"), declares)
    a = assign_units(q, training_rows, confident)
    units = F.broadcast(_spellings(measures.sparkSession).groupBy("kind", "label", "factor", "offset").count().drop("count"))
    a = a.withColumn("taken", F.coalesce("assigned", "declared")).join(
        units.select("kind", *(F.col(c).alias(f"given_{c}") for c in ("label", "factor", "offset"))), (F.col("taken") == F.col("given_label")) & (F.col("quantity_kind") == F.col("kind")), "left",
    )
    origin = F.when(F.col("given_label").isNull(), "review").when(F.col("assigned").isNotNull(), "predicted").otherwise("declared")
    a = a.withColumn("origin", origin).withColumn("common", F.col("value") * F.col("given_factor") + F.col("given_offset")).withColumn("declares", declares).select(*stated.columns)
    unit = F.element_at(F.create_map(*(F.lit(x) for item in COMMON.items() for x in item)), F.col("quantity_kind"))
    return stated.unionByName(a).select(
        "measure_id", "quantity_kind", unit.alias("common_unit"), F.round("common").cast("bigint").alias("common_value"), "origin", "probability", "declares"
    )


def review(measures: DataFrame, source_units: DataFrame) -> DataFrame:
    """Measures for people to look at: uncertain predictions, and confident ones where the source declares nothing, with the value they would get."""
    c = convert(measures, source_units).where("origin IN ('declared', 'review') OR origin = 'predicted' AND NOT declares")
    return c.select("measure_id", "quantity_kind", "common_value", "origin", F.round("probability", 4).alias("probability"))


def units_found(measures: DataFrame, source_units: DataFrame) -> DataFrame:
    """Measures whose value and unit can be told: ``(measure_id, common_unit, common_value)``.

    A unit that is nowhere stated can be told only where the source declares what it means; which unit
    that is the forest decides where it is confident.
    """
    told = convert(measures, source_units).where("(origin = 'stated' OR origin <> 'review' AND declares) AND common_value IS NOT NULL")
    return told.select("measure_id", "common_unit", "common_value")
