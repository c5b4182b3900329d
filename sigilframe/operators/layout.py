"""Column gutters: found on a page from empty vertical strips, or taken over from the rest of the paper."""

from __future__ import annotations

import numpy as np

from .lines import Glyph, Line


def column_boundary(glyphs: list[Glyph], width: float | None) -> float | None:
    x0, x1, top = (np.array([getattr(g, c) for g in glyphs], float) for c in ("x0", "x1", "top"))
    return gutter(x0, x1, top, width)


def gutter(x0: np.ndarray, x1: np.ndarray, top: np.ndarray, width: float | None) -> float | None:
    """The middle of a nearly empty central strip with text on both sides; None if there is none."""
    if not width or width <= 0 or len(x0) < 40:
        return None
    n = int(width) + 1
    # Each whole x that a glyph covers, with the glyph's height band; a band counts once per x.
    lo = np.maximum(0, x0.astype(int))
    reach = np.clip(np.minimum(n - 1, x1.astype(int)) - lo, 0, None) + 1
    reach = np.where(lo < n, np.minimum(reach, n - lo), 0)
    at = np.repeat(lo, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    cells = np.unique(np.column_stack([at, np.repeat((top / 2).astype(int), reach)]), axis=0)
    density = np.bincount(cells[:, 0], minlength=n)
    peak = int(density.max(initial=0))
    if peak < 2:
        return None
    # Runs of sparse columns of x, the page's own edges left out.
    sparse = np.zeros(n + 1, bool)
    sparse[1 : n - 1] = density[1 : n - 1] <= max(1, int(0.22 * peak))
    starts, ends = np.flatnonzero(sparse[1:] & ~sparse[:-1]) + 1, np.flatnonzero(~sparse[1:] & sparse[:-1]) + 1
    found = []
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        off = abs((lo + hi) / 2 - width / 2)
        if hi - lo < 8 or density[lo:hi].mean() > 0.12 * peak or off > 0.07 * width:
            continue
        if min((x1 <= lo).sum(), (x0 >= hi).sum()) < 0.12 * len(x0):
            continue
        found.append((hi - lo, -off, (lo + hi) / 2))
    return max(found)[2] if found else None  # the widest, then the most central


def follows_boundary(lines: list[Line], boundary: float | None) -> bool:
    """Whether enough lines of a page leave a gap at a boundary known from other pages."""
    if boundary is None:
        return False
    both = split = 0
    for line in lines:
        left, right = [g.x1 for g in line.g if g.x1 < boundary], [g.x0 for g in line.g if g.x0 > boundary]
        if left and right:
            both += 1
            split += min(right) - max(left) >= 8.0
    return split >= 5 and split >= 0.45 * both


def sides(line: Line, boundary: float | None) -> list[Line]:
    """The line's parts left and right of the boundary; one part without a boundary."""
    if boundary is None:
        return [line]
    return [Line([g for g in line.g if (g.center >= boundary) == right], line.page, line.number) for right in (False, True)]
