"""Character tables made from the Unicode database that ships with Python, and one list of look-alike letters."""

from __future__ import annotations

import unicodedata
from functools import cache

#: Cyrillic, Armenian and Greek letters that look like a Latin one.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝкьҮүѴѵ"
_CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxhdqwkbYyVv"
_ARMENIAN, _ARMENIAN_AS = "ՕօՏոսցհ", "OoSnugh"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγεηικνορτυχω"
_GREEK_AS = "ABEZHIKMNOPTYXayenikvoptuxw"
#: Letters that look like a digit.
_DIGITLIKE = "OoОоΟοlIІіΙιЗзҘБбЅѕ"
_DIGITLIKE_AS = "00000011111133366" + "55"

TO_LATIN = dict(zip(_CYRILLIC + _GREEK + _ARMENIAN, _CYRILLIC_AS + _GREEK_AS + _ARMENIAN_AS, strict=True))
#: From Latin to Cyrillic, for a Latin letter inside a Cyrillic word.
TO_CYRILLIC = {latin: c for c, latin in reversed(list(zip(_CYRILLIC, _CYRILLIC_AS, strict=True)))}
#: Leading consonants, vowels and trailing consonants of Hangul syllables, in the order that numbers them.
HANGUL = tuple("".join(chr(start + i) for i in range(n)) for start, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
TO_DIGIT = dict(zip(_DIGITLIKE, _DIGITLIKE_AS, strict=True))

_HYPHENS = "‐‑‒–—―−﹘﹣－"
_APOSTROPHES = "‘’‚‛ʼʹ′`´＇ʻ"
_INVISIBLE = "­͏᠎︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"


def plain_of(ch: str) -> str:
    """What one character stands for: compatibility forms undone and decomposed, spaces, hyphens and apostrophes plain, invisible ones empty."""
    if ch in _HYPHENS:
        return "-"
    if ch in _APOSTROPHES and ch != "`":
        return "'"
    category = unicodedata.category(ch)
    if ch in _INVISIBLE or category == "Cf" or (category == "Cc" and ch not in "\t\n\r"):
        return ""
    if category in ("Zs", "Zl", "Zp") or ch in "\t\n\r":
        return " "
    if category == "Nd":
        return str(unicodedata.digit(ch))
    if ch == "ɡ":  # the script form of g, no letter of its own outside phonetics
        return "g"
    if 0xAC00 <= ord(ch) <= 0xD7A3:
        return ch
    return "".join("/" if c == "⁄" else " " if unicodedata.category(c) == "Zs" else c for c in unicodedata.normalize("NFKD", ch))


def script_of(ch: str) -> str:
    """``latin``, ``cyrillic``, ``greek``, ``armenian``, ``digit``, ``mark``, ``other`` for letters of other scripts, and empty for what ends a word."""
    if unicodedata.combining(ch):
        return "mark"
    category = unicodedata.category(ch)
    if category == "Nd":
        return "digit"
    if category[0] != "L":
        return ""
    name = unicodedata.name(ch, "")
    return next((s.lower() for s in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN") if name.startswith(s)), "other")


@cache
def characters() -> list[tuple[str, list[tuple[str, int, str]]]]:
    """``(character, [(plain character, combining class, script)])`` for every assigned character but plain CJK and Hangul."""
    rows = []
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0xE000 <= cp < 0xF900 or 0x17000 <= cp < 0x1B000 or cp >= 0x20000 and not 0x2F800 <= cp < 0x2FA20 and not 0xE0000 <= cp < 0xE0080:
            continue
        ch = chr(cp)
        if unicodedata.category(ch) == "Cn":
            continue
        to = plain_of(ch)
        script = script_of(ch)
        if to != ch or script not in ("other", ""):
            rows.append((ch, [(c, unicodedata.combining(c), script_of(c)) for c in to]))
    return rows


@cache
def compositions() -> list[tuple[str, str]]:
    """``(base + mark, composed character)`` for every canonical composition but Hangul, which follows a rule."""
    rows = []
    for cp in (*range(0x00C0, 0xAC00), *range(0xF900, 0x20000)):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == chr(cp):
                rows.append((pair, chr(cp)))
    return rows
