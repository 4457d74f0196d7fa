from __future__ import annotations

import unicodedata

import pytest

from folioscope.llm import charmap, plaintext

CASES = [
    ("Ｄｕｎｃｒｏ　ＬＴＤ．", "Duncro LTD."), ("Référence", "Référence"), ("a​b­c﻿", "abc"), ("3 304,14 €", "3 304,14 €"), ("ѕupplіеr", "supplier"),
    ("Завод Жарник", "Завод Жарник"), ("Φ 20", "Φ 20"), ("З35,22 €", "335,22 €"), ("І38", "138"), ("$3,3O5.6l", "$3,305.61"), ("(O1,250)", "(01,250)"), ("ﬁlter", "filter"), ("㈱ｷﾞﾍﾟ", "(株)ギペ"),
    ("株式会社⼤", "株式会社大"), ("KN–83", "KN-83"), ("d’acier", "d'acier"), ("١٢", "12"), ("Zавод", "Zaвoд"), ("バ", "バ"), ("​", ""), ("Ⅱ", "II"), ("plain text 12", "plain text 12"),
    ("q̣̇", "q̣̇"), ("Tamlol 5", "Tamlol 5"), ("Model I", "Model I"), ("0.5 l", "0.5 l"), ("І 911 461,35 €", "1 911 461,35 €"), ("l 911,35", "1 911,35"),
    ("\u1112\u1161\u11ab\u1100\u116e\u11a8", "한국"), ("한국", "한국"), ("ᄒ", "ᄒ"), ("a\u1161", "a\u1161"), ("가\u11a8\u11a8", "각\u11a8"), ("\U00011099\U000110ba", "\U0001109a"), ("Pհօtօ", "Photo"), ("ɡear", "gear"), ("Հայ", "Հայ"),
]


@pytest.fixture(scope="module")
def plains(spark):
    values = spark.createDataFrame([(v,) for v, _ in CASES] + [(None,), ("",)] + [(CASES[0][0],)] * 20, "value string")
    return {r.value: r.plain for r in plaintext.plain_values(values).collect()}


@pytest.mark.parametrize("value,plain", CASES)
def test_plain(plains, value, plain):
    assert plains.get(value, value) == plain


def test_agrees_with_the_standard_form_where_no_lookalikes_are(spark):
    texts = ["é̄ ﬀ ① ｶﾞｷﾞ", "ệx", "Å Å Å", "½ kg", "Ǖ ṩ ṩ ṩ"]
    got = {r.value: r.plain for r in plaintext.plain_values(spark.createDataFrame([(t,) for t in texts], "value string")).collect()}
    for t in texts:
        assert got.get(t, t) == unicodedata.normalize("NFKC", t).replace("⁄", "/")


def test_edges(spark):
    schema = "cell_id bigint, text string, company string, amount string, value string, plain string, word string"
    long = "ａ" * 20_000
    df = spark.createDataFrame([(1, long, None, "", "x", "y", "z"), (2, None, None, None, "x", "y", "z"), (1, long, None, "", "x", "y", "z")], schema)
    assert [tuple(r) for r in plaintext.found(df).collect()] == [(1, "text")]
    assert plaintext.changed_fields(df, "cell_id", ["text"]).first().plain == "a" * 20_000
    assert plaintext.found(df.limit(0)).count() == 0


def test_tables_are_bounded():
    assert len(charmap.characters()) < 20_000 and len(charmap.compositions()) < 2_000
