"""Synthetic glyph pages."""

from sigilframe.operators.lines import Glyph

BASE = {"fontname": "CMMI10", "top": 10.0, "size": 10.0, "width": 5.0}


def run(text, x=72.0, font="CMMI10", top=10.0, size=10.0, start=0, fonts=None):
    """Glyphs of a text; a space leaves a gap of 4 and no glyph, but takes a number."""
    out = []
    for k, ch in enumerate(text):
        if ch == " ":
            x += 4
            continue
        out.append(Glyph(start + k, ch, ch, "native", (fonts or {}).get(k, font), x, x + 5, top, top + size, size))
        x += 5
    return out


def rows(glyphs, paper="P", page=1):
    return [(paper, page, g.index, g.raw, g.font, g.x0, g.x1, g.top, g.bottom, g.size, True) for g in glyphs]
