"""Styles and normal forms of mathematical characters, for single texts and as dimension tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from . import patterns as P

#: Words of a character's name and the style they mean; bold and italic may both hold.
_NAMED = (("DOUBLE-STRUCK", "blackboard"), ("FRAKTUR", "fraktur"), ("SCRIPT", "script"), ("SANS-SERIF", "sans"), ("MONOSPACE", "monospace"))
#: Greek letter names as the character data spell them; glyph names write LAMDA with a B.
GREEK = {unicodedata.name(c).removeprefix("GREEK SMALL LETTER "): c for c in map(chr, range(0x3B1, 0x3CA)) if c != "ς"}
GREEK["LAMBDA"] = GREEK["LAMDA"]

_FONT_STYLES = [(style, re.compile(p)) for style, p in P.FONT_STYLES]
_SUBSET = re.compile(P.SUBSET_PREFIX)


@lru_cache(maxsize=8192)
def char_style(char: str) -> str | None:
    """The style of a mathematical character; None for all others."""
    name = unicodedata.name(char, "")
    if "MATHEMATICAL" not in name:
        return None
    for word, style in _NAMED:
        if word in name:
            return style
    bold, italic = "BOLD" in name, "ITALIC" in name
    return {(1, 1): "bold_italic", (1, 0): "bold", (0, 1): "italic"}.get((bold, italic), "roman")


def text_style(text: str | None) -> str | None:
    styles = sorted({s for s in map(char_style, text or "") if s})
    return None if not styles else styles[0] if len(styles) == 1 else "mixed:" + "+".join(styles)


def family_of(font: str | None) -> str:
    return _SUBSET.sub("", font or "")


@lru_cache(maxsize=8192)
def font_style(font: str | None) -> str:
    family = family_of(font)
    upper = family.upper()
    return next((s for s, p in _FONT_STYLES if p.search(upper)), f"font:{family or 'unknown'}")


def style_of(given: str | None, text: str | None, font: str | None) -> str:
    return given or text_style(text) or font_style(font)


def normal_form(text: str | None) -> str | None:
    """NFKC of each character by itself."""
    return text and "".join(unicodedata.normalize("NFKC", c) for c in text)


#: Accents as character names and as glyph names spell them.
ACCENTS = {
    "GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron",
    "BREVE": "breve", "MACRON": "macron", "OGONEK": "ogonek", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut", "STROKE": "slash", "COMMA BELOW": "commaaccent",
}
#: Standard names of characters that no rule below gives.
GLYPH_NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª",
    "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "twosuperior": "²", "threesuperior": "³", "acute": "´", "mu": "µ",
    "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾",
    "questiondown": "¿", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "dotlessi": "ı", "Dcroat": "Đ", "dcroat": "đ",
    "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜",
    "hungarumlaut": "˝", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„",
    "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "minute": "′", "second": "″", "prime": "′", "guilsinglleft": "‹", "guilsinglright": "›",
    "fraction": "⁄", "Euro": "€", "trademark": "™", "Delta": "∆", "Omega": "Ω", "theta1": "ϑ", "phi1": "ϕ", "sigma1": "ς", "omega1": "ϖ", "Upsilon1": "ϒ",
    "aleph": "ℵ", "Ifraktur": "ℑ", "Rfraktur": "ℜ", "weierstrass": "℘", "arrowleft": "←", "arrowup": "↑", "arrowright": "→", "arrowdown": "↓", "arrowboth": "↔",
    "arrowdblleft": "⇐", "arrowdblright": "⇒", "arrowdblboth": "⇔", "universal": "∀", "partialdiff": "∂", "existential": "∃", "emptyset": "∅", "gradient": "∇", "element": "∈",
    "notelement": "∉", "suchthat": "∋", "product": "∏", "summation": "∑", "minus": "−", "asteriskmath": "∗", "radical": "√", "proportional": "∝", "infinity": "∞", "angle": "∠",
    "logicaland": "∧", "logicalor": "∨", "intersection": "∩", "union": "∪", "integral": "∫", "therefore": "∴", "similar": "∼", "congruent": "≅", "approxequal": "≈", "notequal": "≠",
    "equivalence": "≡", "lessequal": "≤", "greaterequal": "≥", "propersubset": "⊂", "propersuperset": "⊃", "notsubset": "⊄", "reflexsubset": "⊆", "reflexsuperset": "⊇",
    "circleplus": "⊕", "circlemultiply": "⊗", "perpendicular": "⊥", "dotmath": "⋅", "multiply": "×", "divide": "÷", "angleleft": "〈", "angleright": "〉", "lozenge": "◊",
}


def _accented(chars: Iterable[str]) -> dict[str, str]:
    """Letters with one accent: the base letter and the accent's name, as in Aacute."""
    out = {}
    for c in chars:
        m = re.fullmatch(r"LATIN (CAPITAL|SMALL) LETTER ([A-Z]) WITH (.+)", unicodedata.name(c, ""))
        if m and m[3] in ACCENTS:
            out.setdefault((m[2] if m[1] == "CAPITAL" else m[2].lower()) + ACCENTS[m[3]], c)
    return out


#: Cyrillic letters go by number: two runs of the alphabet, in which one letter follows the sixth.
_CYRILLIC = [*map(chr, range(0x410, 0x416)), "Ё", *map(chr, range(0x416, 0x430))]
NAMED = _accented(map(chr, range(0xC0, 0x250))) | {f"afii{first + k}": c for first, letters in ((10017, _CYRILLIC), (10065, [c.lower() for c in _CYRILLIC])) for k, c in enumerate(letters)} | GLYPH_NAMES


def _one_name(key: str) -> str | None:
    if len(key) == 1:
        return key
    if key in NAMED:
        return NAMED[key]
    if m := re.fullmatch("uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", key):
        codes = [int(m[1][k : k + 4], 16) for k in range(0, len(m[1]), 4)] if m[1] else [int(m[2], 16)]
        return "".join(map(chr, codes)) if max(codes) <= 0x10FFFF and not any(0xD800 <= c < 0xE000 for c in codes) else None
    if key.upper() in GREEK:
        letter = GREEK[key.upper()]
        return letter.upper() if key == key.capitalize() else letter
    if key.endswith("tonos") and key[:-5].upper() in GREEK:
        return unicodedata.normalize("NFC", _one_name(key[:-5]) + "\u0301")
    return None


def glyph_name_char(name: str | None) -> str | None:
    """The text of a glyph name: whole, without trailing digits, without a variant's suffix, or part by part.

    Greek names give the capital where only their first letter is one, else the small letter.
    """
    whole = (name or "").lstrip("/")
    for key in (whole, whole.rstrip("0123456789")):
        if found := _one_name(key):
            return found
    base = whole.partition(".")[0]
    parts = [_one_name(part) for part in base.split("_")]
    return "".join(parts) if base and all(parts) and (base != whole or len(parts) > 1) else None


def math_characters(spark: SparkSession) -> DataFrame:
    """Dimension (ch, style, normal) of all mathematical characters, built from the Unicode data."""
    rows = [(c, char_style(c), normal_form(c)) for c in map(chr, range(0x110000)) if char_style(c)]
    return spark.createDataFrame(rows, "ch string, style string, normal string")
