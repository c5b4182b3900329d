"""Definition events of a page: seeds, windows, columns, sentence ends, evidence per symbol."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions import patterns as P
from .layout import sides
from .lines import GENERIC, Line, Token, box, collapse, definition_like, formula_signal

REACH, SENTENCE, LOCAL, CAP = 10, 5, 3, 720
_TRIGGER, _RELATION = re.compile(P.TRIGGER, re.I), re.compile(P.RELATION, re.I)
#: Fixed value: bare trigger words that mark a column even where its symbols are lost.
_BARE = re.compile(r"\b(?:where|let|denote(?:d|s)?|define[sd]?|given)\b|(?:其中|式中|表示|定义|记为|记作|设|令|分别为|对应于|称为)", re.I)


@dataclass
class Symbol:
    surface: str
    identity_key: str
    style: str
    status: str
    level: int
    types: list[str] = field(default_factory=list)
    token_ids: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)


@dataclass
class Event:
    definition_id: str
    line_ids: list[str]
    text: str
    bbox: list[float]
    trigger: str
    window: list[int]
    symbols: list[Symbol]


LEVEL_TYPES = {3: "direct_definition", 2: "formula_context", 1: "event_context"}


class EventFinder:
    """Events of one page.  ``gated`` says which lines count as definitions; ``stop`` is the line of a
    references heading on this page, from which no event starts."""

    def __init__(self, lines: list[Line], gated: list[bool], stop: int | None, boundary: float | None):
        self.lines, self.gated, self.boundary = lines, gated, boundary
        self.stop = len(lines) if stop is None else stop
        self.texts = [line.text for line in lines]
        self.has = [bool(line.tokens) for line in lines]

    def joined(self, lo: int, hi: int) -> str:
        return " ".join(self.texts[lo:hi])

    def seeds(self) -> list[int]:
        def starts(i: int) -> bool:
            if not any(self.has[i : i + 3]) or GENERIC.search(self.texts[i]):
                return False
            return self.lines[i].definition or (self.lines[i].formula and self.has[i] and formula_signal(self.joined(i, i + 7)))

        return [i for i in range(min(self.stop, len(self.lines))) if starts(i)]

    def window(self, seed: int) -> range:
        """The seed and the lines behind it that go on with its definition."""
        end = min(len(self.lines), seed + REACH + 1)
        anchored = any(self.gated[seed : seed + 4]) or formula_signal(self.joined(seed, seed + 7))
        last_token = max((i for i in range(seed + 1, end) if self.has[i]), default=-1)
        for i in range(seed + 1, end):
            rest = self.joined(i, end)
            on = self.has[i] or (anchored and (self.lines[i].formula or last_token > i or formula_signal(rest))) or definition_like(rest)
            if not on:
                return range(seed, i)
        return range(seed, end)

    def _score(self, part: Line) -> int:
        n, t = part.counts, len(part.tokens)
        return 9 * bool(_BARE.search(part.text)) + 10 * part.definition + 4 * formula_signal(part.text) + 3 * bool(n["operator"] and t) + 2 * (n["family"] >= 2) + min(3, t)

    def column(self, window: range) -> int | None:
        """The side of the gutter that holds the event; None for whole lines."""
        if self.boundary is None:
            return None
        totals = [0, 0]
        for i in window:
            for side, part in enumerate(sides(self.lines[i], self.boundary)):
                totals[side] += self._score(part) if part else 0
        if totals[0] != totals[1]:
            return int(totals[1] > totals[0])
        seed = self.lines[window[0]]
        parts = sides(seed, self.boundary)
        if not all(parts):
            return int(sum(g.center for g in seed.g) / len(seed.g) >= self.boundary)
        scores = [8 * p.definition + 3 * formula_signal(p.text) + 2 * bool(p.counts["math"]) + min(2, len(p.tokens)) for p in parts]
        return int(scores[1] >= scores[0]) if max(scores) > 0 else None

    def part(self, i: int, column: int | None) -> Line:
        return self.lines[i] if self.boundary is None or column is None else sides(self.lines[i], self.boundary)[column]

    def to_sentence_end(self, window: range, column: int | None) -> range:
        text = " ".join(self.part(i, column).text for i in window).strip()
        if not (definition_like(text) or formula_signal(text)) or re.search(r"[.!?。！？]\s*$", text):
            return window
        end = window.stop
        for i in range(window.stop, min(len(self.lines), window.stop + SENTENCE)):
            end = i + 1
            if re.search(r"[.!?。！？](?:\s|$)", self.part(i, column).text.strip()):
                break
        return range(window.start, end)

    def relation_clause(self, texts: list[str]) -> str:
        whole = collapse(" ".join(filter(None, texts)))
        m = _RELATION.search(whole)
        if not m:
            return ""
        clause = whole[m.start() :]
        end = re.search(r"[.;。；](?:\s|$)", clause)
        return (clause[: end.end()].strip() if end else clause)[:CAP].strip()

    def evidence(self, surface: str, at: int, lines: range, column: int | None, clause: str) -> str:
        """The symbol's own line with at most two that go on with it, and the relation clause."""
        parts: list[str] = []
        for i in range(at, min(at + LOCAL, lines.stop)):
            text = self.part(i, column).text.strip()
            if not text:
                continue
            if i != at:
                both = self.gated[at] and self.gated[i]
                if both or not (self.gated[i] or self.lines[i].formula or formula_signal(" ".join([*parts, text]))):
                    break
            parts.append(text)
            if len(" ".join(parts)) >= CAP:
                break
        out = collapse(" ".join(parts))
        if clause and (surface in clause or re.search(r"\b(?:and|represent|denote|is|are)\b", clause, re.I)):
            out = f"{out} {clause}" if out else clause
        return out if len(out) <= CAP else out[: CAP - 3].rstrip() + "..."

    def event(self, seed: int, window: range) -> Event | None:
        column = self.column(window)
        lines = self.to_sentence_end(window, column)
        parts = {i: self.part(i, column) for i in lines}
        clause = self.relation_clause([parts[i].text.strip() for i in lines])
        found: dict[str, Symbol] = {}
        for i in window:
            part = parts[i]
            level = 3 if part.definition else 2 if part.formula else 1
            for t in part.tokens if part else []:
                self._add(found, t, level, self.evidence(t.surface, i, lines, column, clause))
        if not found:
            return None
        text = " ".join(parts[i].text for i in lines if parts[i].text)
        trigger = _TRIGGER.search(text)
        glyphs = [g for i in lines for g in parts[i].g]
        return Event(f"p{self.lines[seed].page}:definition{seed}", [self.lines[i].id for i in lines], text, box(glyphs), trigger[0] if trigger else "", list(window), list(found.values()))

    @staticmethod
    def _add(found: dict[str, Symbol], t: Token, level: int, text: str) -> None:
        s = found.setdefault(t.identity, Symbol(t.surface, t.identity, t.style, t.status, level))
        s.level = max(s.level, level)
        s.token_ids.append(t.token_id)
        for values, x in ((s.types, LEVEL_TYPES[level]), (s.texts, text)):
            if x and x not in values:
                values.append(x)

    def events(self) -> tuple[list[Event], list[int]]:
        """Events in order, and the lines their windows claim, also those of windows without symbols."""
        out, claimed = [], set()
        for seed in self.seeds():
            if seed in claimed:
                continue
            window = self.window(seed)
            claimed.update(window)
            if e := self.event(seed, window):
                out.append(e)
        return out, sorted(claimed)
