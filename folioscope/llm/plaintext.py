"""Visually identical text brought to one plain form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioscope.llm import charmap


def _characters(spark: SparkSession) -> DataFrame:
    """The fixed table of characters (about 10,000 rows, whatever the data)."""
    schema = "ch string, parts array<struct<c string, ccc int, script string>>"
    return spark.createDataFrame(charmap.characters(), schema)


def _lookalikes(spark: SparkSession) -> DataFrame:
    """The fixed table of look-alike letters: ``(c, latin, cyrillic, digit)``."""
    letters = sorted({*charmap.TO_LATIN, *charmap.TO_CYRILLIC, *charmap.TO_DIGIT})
    rows = [(x, charmap.TO_LATIN.get(x), charmap.TO_CYRILLIC.get(x), charmap.TO_DIGIT.get(x)) for x in letters]
    return spark.createDataFrame(rows, "c string, latin string, cyrillic string, digit string")


def _hangul(base: Column, c: Column) -> Column:
    """The syllable of a leading consonant and a vowel, or of a syllable without and a trailing consonant; else null."""
    lead, vowel, trail = charmap.HANGUL
    place = lambda x, row: F.instr(F.lit(row), x) - 1
    number = F.conv(F.hex(F.encode(base, "UTF-16BE")), 16, 10).try_cast("int") - 0xAC00
    syllable = lambda n: F.decode(F.unhex(F.hex(n + 0xAC00)), "UTF-16BE")
    first = (place(base, lead) >= 0) & (place(c, vowel) >= 0)
    second = base.between("가", "힣") & (number % 28 == 0) & (place(c, trail) >= 0)
    return F.when(first, syllable((place(base, lead) * 21 + place(c, vowel)) * 28)).when(second, syllable(number + place(c, trail) + 1))


def _compose(cluster: Column) -> Column:
    """A starter with its marks in order, composed as far as possible (a mark is blocked by one of its own class)."""
    table = F.create_map(*(F.lit(x) for pair in charmap.compositions() for x in pair))

    def step(state: Column, mark: Column) -> Column:
        whole = F.coalesce(F.element_at(table, F.concat(state["base"], mark["c"])), F.when(mark["c"].between("\u1161", "\u11c2"), _hangul(state["base"], mark["c"])))
        joins = whole.isNotNull() & (state["last"] != mark["ccc"])
        return F.struct(
            F.when(joins, whole).otherwise(state["base"]).alias("base"),
            F.when(joins, state["kept"]).otherwise(F.concat(state["kept"], mark["c"])).alias("kept"),
            F.when(joins, state["last"]).otherwise(mark["ccc"]).alias("last"),
        )

    start = F.struct(F.element_at(cluster, 1)["c"].alias("base"), F.lit("").alias("kept"), F.lit(-1).alias("last"))
    return F.aggregate(F.slice(cluster, 2, F.size(cluster)), start, step, lambda s: F.concat(s["base"], s["kept"]))


def plain_values(values: DataFrame) -> DataFrame:
    """``(value, plain)`` for every distinct value of the column ``value`` that may not be plain.

    Values are exploded to positioned code points, a broadcast join gives each its decomposition,
    marks are put in order of their class behind their letter, letters of a word that looks like one
    script but mixes several are replaced by their look-alikes, letters inside numbers by digits,
    marks are recomposed and the value rebuilt. A value travels once through one shuffle, however
    often it occurs, and all later groupings reuse that partitioning.

    Defined results: null and values of printable ASCII without a letter-for-digit are plain already
    and not returned; a value of invisible characters only becomes the empty string; a word wholly in
    another script stays; a mixed word becomes Latin unless only its Cyrillic letters are unmistakable;
    a letter is read as a digit in a run of letters and digits all of whose letters look like digits,
    and everywhere in a value made of digits, such letters and number punctuation only, unless it ends in
    a letter of its own (a unit).
    """
    spark = values.sparkSession
    number = r"^(?=.*[0-9])[^A-HJ-NP-Za-kmnp-z]*[OolI][^A-HJ-NP-Za-kmnp-z]*$"
    odd = F.col("value").rlike(rf"[^\x20-\x7e]|[0-9][OolI]|[OolI][0-9]|{number}")
    distinct = values.where(F.col("value").isNotNull() & odd).select("value").distinct()
    chars = distinct.select("value", F.posexplode(F.split("value", "")).alias("pos", "ch"))
    chars = chars.join(F.broadcast(_characters(spark)), "ch", "left")
    default = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"), F.when(F.col("ch").rlike(r"\p{L}"), "other").otherwise("").alias("script")))
    parts = chars.select("value", "pos", F.posexplode(F.coalesce("parts", default)).alias("sub", "p"))
    parts = parts.select("value", (F.col("pos").cast("bigint") * 64 + F.col("sub")).alias("at"), "p.c", "p.ccc", "p.script")
    parts = parts.join(F.broadcast(_lookalikes(spark)), "c", "left").repartition("value")

    ordered = Window.partitionBy("value").orderBy("at")
    whole = Window.partitionBy("value")
    word = Window.partitionBy("value", "word")
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    script, digit = F.col("script"), F.col("digit")
    letter = script.isin("latin", "cyrillic", "greek", "armenian", "other")
    jamo = F.col("c").between("\u1161", "\u11c2") & F.lag("c").over(ordered).rlike("^[\u1100-\u11c2가-힣]$")  # goes on with the syllable before it
    parts = parts.withColumn("begins", ((F.col("ccc") == 0) & ~F.coalesce(jamo, F.lit(False))).cast("int"))
    parts = parts.withColumns({
        "starter": F.sum("begins").over(ordered),
        "word": F.sum((script == "").cast("int")).over(ordered),
        "number": has(script == "digit").over(whole) & ~has((letter & digit.isNull()) | (script == "mark")).over(whole)
        & ~has((script == "") & ~F.col("c").rlike(r"^[-+.,'/:()%\s\p{Sc}]$")).over(whole)
        & ~F.col("value").rlike(r"[0-9]\s+[A-Za-z]$"),  # a letter behind the number is its unit
    })
    parts = parts.withColumns({
        "in_number": has(script == "digit").over(word) & ~has((letter & digit.isNull()) | (script == "mark")).over(word),
        "has_latin": has(script == "latin").over(word),
        "sure_latin": has((script == "latin") & F.col("cyrillic").isNull()).over(word),
        "has_other": has(script.isin("cyrillic", "greek", "armenian")).over(word),
        "sure_other": has(script.isin("cyrillic") & F.col("latin").isNull()).over(word),
    })
    mixed = F.col("has_latin") & F.col("has_other")
    to_cyrillic = mixed & ~F.col("sure_latin") & F.col("sure_other")
    plain = (
        F.when(letter & (F.col("number") | F.col("in_number")) & digit.isNotNull(), digit)
        .when(to_cyrillic & (script == "latin"), F.coalesce("cyrillic", "c"))
        .when(mixed & ~to_cyrillic & script.isin("cyrillic", "greek", "armenian"), F.coalesce("latin", "c"))
        .otherwise(F.col("c"))
    )
    clusters = parts.withColumn("c", plain).groupBy("value", "starter").agg(F.sort_array(F.collect_list(F.struct("ccc", "at", "c"))).alias("cluster"))
    composed = F.when(F.size("cluster") == 1, F.element_at("cluster", 1)["c"]).otherwise(_compose(F.col("cluster")))
    rebuilt = clusters.select("value", "starter", composed.alias("c")).groupBy("value").agg(F.sort_array(F.collect_list(F.struct("starter", "c"))).alias("all"))
    rebuilt = rebuilt.select("value", F.array_join(F.transform("all", lambda x: x["c"]), "").alias("plain"))
    nothing = distinct.where(F.col("value").rlike(r"^[\p{Cf}\p{Cc}\x{34f}\x{fe00}-\x{fe0f}]+$") & ~F.col("value").rlike(r"[\t\n\r]"))
    return rebuilt.unionByName(nothing.select("value", F.lit("").alias("plain")))


def _fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), df[f].alias("value")) for f in fields)))
    return df.select(df[key].alias("record_id"), pairs.alias("p")).select("record_id", "p.field_name", "p.value").where("value IS NOT NULL AND value <> ''")


def changed_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(record_id, field_name, value, plain)`` for the distinct values that are not in plain form. Other columns don't matter."""
    cells = _fields(df, key, fields)
    changed = plain_values(cells).where(~F.col("value").eqNullSafe(F.col("plain")))
    return cells.join(changed, "value").select("record_id", "field_name", "value", "plain").distinct()


def normalize(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(record_id, field_name, plain)`` for every distinct non-empty value, changed or not."""
    cells = _fields(df, key, fields).distinct()
    return cells.join(plain_values(cells), "value", "left").select("record_id", "field_name", F.coalesce("plain", "value").alias("plain"))


def found(cells: DataFrame) -> DataFrame:
    """``(cell_id, field_name)`` of the values in ``cells`` that are not in plain form."""
    return changed_fields(cells, "cell_id", ["text", "company", "amount"]).select(F.col("record_id").alias("cell_id"), "field_name").distinct()
