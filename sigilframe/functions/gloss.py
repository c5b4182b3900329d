"""Short glosses of a symbol from its author's text, as Columns.

A gloss pattern is a verb phrase behind the row's own symbol, so patterns are columns too, with the symbol
quoted in them.  Everything stays on the JVM; a pattern is compiled anew only where the symbol changes.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What stands where no gloss is found, and the greatest length of a gloss.
NO_GLOSS = "作者定义的数学符号"
MAX_GLOSS = 40
#: Characters that end a gloss or are cut off its ends, and verbs that begin one.
STOPS = ",.;:，。；："
VERBS = r"is\s+called|defined\s+as|refers?\s+to|denotes?|means?|represents?|is|are"
CHINESE_VERBS = "为|是|表示|定义为|记为|称为"
#: Marks of an equation's remains, in a gloss and in a whole text.
EQUATION = ("def", "∈", "×", "→", "{", "}")
NUMBERED = ("(1.1)", "(1.4)", "(2.2)", "=def", "→", "∈")
#: Characters kept before and behind the symbol in an excerpt, or from the text's beginning.
BEFORE, BEHIND, WHOLE = 160, 540, 700
_LETTER = "A-Za-zΑ-Ωα-ω"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _quoted(surface: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(surface, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _collapsed(text: Column, ends: str = STOPS) -> Column:
    """White space runs become one space; spaces and ``ends`` are cut off."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" " + ends))


def _has(text: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(text, m))


def _short(text: Column) -> Column:
    head = F.regexp_replace(F.substring(text, 1, MAX_GLOSS - 3), r"(?U)\s+$", "")
    return F.when(F.char_length(text) <= MAX_GLOSS, text).otherwise(F.concat(head, F.lit("…")))


def _phrase(text: Column, pattern: Column) -> Column:
    """What the pattern's first match holds, up to a clause of its own; null where it says nothing."""
    value = _collapsed(F.call_function("regexp_extract", text, pattern, F.lit(1)))
    value = F.btrim(F.regexp_replace(value, rf"(?siU)\s+(?:where|while|and\s+[{_LETTER}]\s+(?:is|are)\b).*$", ""), F.lit(" " + STOPS))
    norm = F.when(F.contains(value, F.lit("ℓ")) & ~value.rlike(r"(?iU)\bnorm\b"), F.concat(value, F.lit(" norm"))).otherwise(value)
    return F.when((value != "") & ~value.rlike(r"(?iU)^(?:defined|deﬁned)\s+by\b") & ~_has(value, EQUATION), norm)


def _indexed(text: Column, pattern: Column) -> Column:
    """Whether another letter stands alone just before the first match: the tail of a flattened index, as in "x i is"."""
    at = F.call_function("regexp_instr", text, pattern)
    return F.substring(text, F.greatest(F.lit(1), at - 12), F.least(F.lit(12), at - 1)).rlike(rf"(?U)(?<![{_LETTER}])[{_LETTER}]\s+$")


def _found(surface: Column, text: Column) -> Column:
    """The gloss of the first way of defining that gives one; null without.

    Verbs are read in either case, the symbol in its own: B(b) says nothing of b.
    """
    symbol, flags = F.concat(F.lit("(?-i:"), _quoted(surface), F.lit(")")), F.lit("(?iU)")
    alone = F.concat(flags, F.lit("(?<![A-Za-z])"), symbol)
    typed = F.concat(alone, F.lit(rf"(?:\s*\([^)]{{0,40}}\))?\s*(?::\s*[^{STOPS}]{{1,80}})?\s+(?:{VERBS})\s+([^{STOPS}]{{3,100}})"))
    sized = F.concat(alone, F.lit(rf"\s*-\s*dimensional\s+([^{STOPS}]{{3,80}})"))
    chinese = F.concat(flags, symbol, F.lit(rf"[^。；;]{{0,40}}?(?:{CHINESE_VERBS})\s*([^，。；;]{{2,80}})"))
    english = [F.when(~_indexed(text, p), _phrase(text, p)) for p in (typed, sized)]
    return _short(F.coalesce(*english, _phrase(text, chinese)))


def gloss(surface: Column | str, text: Column | str) -> Column:
    """{meaning, summary, definition} of a symbol by one text; null where either is null.

    meaning is the gloss or ``NO_GLOSS``; summary falls back on the text's beginning, unless it is an
    equation's remains; definition on the text around the symbol.
    """
    surface, text = _col(surface), _col(text)
    found, plain = _found(surface, text), _collapsed(text)
    at = F.call_function("regexp_instr", plain, F.concat(F.lit("(?<![A-Za-z])"), _quoted(surface), F.lit("(?![A-Za-z])")))
    first = F.greatest(F.lit(1), at - BEFORE)
    around = F.substring(plain, first, at + F.char_length(surface) + BEHIND - first)
    excerpt = F.when(at > 0, F.regexp_replace(around, r"(?U)^\s+|\s+$", "")).otherwise(F.substring(plain, 1, WHOLE))
    out = F.struct(
        F.coalesce(found, F.lit(NO_GLOSS)).alias("meaning"),
        F.coalesce(found, F.when((plain != "") & ~_has(plain, NUMBERED), _short(plain)), F.lit(NO_GLOSS)).alias("summary"),
        F.coalesce(F.concat(surface, F.lit(": "), found), excerpt).alias("definition"),
    )
    return F.when(surface.isNotNull() & text.isNotNull(), out)
