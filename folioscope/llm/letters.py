"""Names in Latin letters, kana and kanji brought to comparable letters (fixed values of the writing systems)."""

from __future__ import annotations

import unicodedata
from functools import cache

#: Consonants and vowels of the kana table, and the syllables that don't follow the table.
_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ",
    "r": "ラリルレロ", "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ",
}
_OTHERS = {
    "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヲ": "wo", "ン": "n", "ヴ": "vu", "シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji",
    "ヂ": "ji", "ヅ": "zu", "ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "ya", "ュ": "yu", "ョ": "yo", "ッ": "", "ー": "", "・": "", "ヶ": "ke", "ヵ": "ka",
}
KANA = {k: c + v for c, row in _ROWS.items() for k, v in zip(row, "aiueo", strict=True)} | _OTHERS

#: Old and variant forms of kanji in names, and the usual form.
_OLD = "髙邊邉濱瀧龍澤廣嶋嶌櫻國齋齊斉﨑碕圓眞惠冨曾會壽榮學實藏德辻鐵條淺增萬豐關舊龜櫛櫔黑鷗靜瀨來將"
_NEW = "高辺辺浜滝竜沢広島島桜国斎斎斎崎崎円真恵富曽会寿栄学実蔵徳辻鉄条浅増万豊関旧亀櫛栃黒鴎静瀬来将"
VARIANTS = dict(zip(_OLD, _NEW, strict=True))


@cache
def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(a): b for a, b in VARIANTS.items()}
    table |= {ord("ぁ") + i: chr(ord("ァ") + i) for i in range(86)}
    table |= {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x200E: None, 0x2060: None, 0xFEFF: None}
    table |= {ord(c): "-" for c in "‐‑‒–—―−"} | {ord(c): "'" for c in "’‘`´"}
    return table


def plain(text: str) -> str:
    """Width, compatibility forms, accents and case gone; kana as katakana; usual kanji."""
    text = unicodedata.normalize("NFKC", text).translate(_fold_table())
    text = unicodedata.normalize("NFKC", text)
    if text.isascii():
        return text.lower()
    out = []
    for ch in text:
        out.append(ch if "぀" <= ch <= "鿿" else "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)))
    return "".join(out).lower()


def is_kana(ch: str) -> bool:
    return "ァ" <= ch <= "ー"


def is_kanji(ch: str) -> bool:
    return "㐀" <= ch <= "鿿" or ch == "々"


def romaji(text: str) -> str:
    return "".join(KANA.get(c, c) for c in text)


@cache
def _syllables() -> dict[str, str]:
    """Romaji of one syllable -> one letter that stands for it (the first kana written so)."""
    table: dict[str, str] = {}
    for kana, latin in KANA.items():
        if latin and latin not in table and kana not in "ァィゥェォャュョヵヶ":
            table[latin] = kana
    return table


def kana_of(latin: str) -> str:
    """Romaji read back as kana; empty when it can't be read."""
    table, out, i = _syllables(), [], 0
    while i < len(latin):
        for n in (3, 2, 1):
            if latin[i : i + n] in table and len(latin[i : i + n]) == n:
                out.append(table[latin[i : i + n]])
                i += n
                break
        else:
            return ""
    return "".join(out)


def distance(a: str, b: str, most: int = 3) -> int:
    """Edits between two strings, a swap of neighbours being one; ``most + 1`` when there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)
