"""Reading order of scanned pages: lines that were read straight across the columns are put back column by column."""

from __future__ import annotations

import re

BREAKS = "-¬\xad"
_BREAK = re.compile(rf"[{BREAKS}]\n")


def _columns(n: int, left: list[int] | None, right: list[int] | None, columns: int | None) -> list[list[int]]:
    """Numbers of the lines of each column, each column from top to bottom (the order in which they are given).

    The widest steps between the sorted left edges part the columns. A line whose box reaches over the start of another
    column holds words of both and is given to both. Without fitting boxes the lines stay as they are.
    """
    if not columns or columns < 2 or not left or not right or len(left) != n or None in left or None in right:
        return [list(range(n))]
    edges = sorted(left)
    steps = sorted(((b - a, b) for a, b in zip(edges, edges[1:])), reverse=True)[: columns - 1]
    starts = sorted([edges[0], *(b for step, b in steps if step > 60)])
    out: list[list[int]] = [[] for _ in starts]
    for k, (x0, x1) in enumerate(zip(left, right)):
        for c, s in enumerate(starts):
            if (s - 30 <= x0 and (c + 1 == len(starts) or x0 < starts[c + 1] - 30)) or x0 < s - 30 and s < x1 - 100:
                out[c].append(k)
    return out


def line_order(text: str, left: list[int] | None, right: list[int] | None, columns: int | None) -> list[tuple[int, int]]:
    """Where each line stands in the text, in reading order."""
    ends = [m.start() for m in re.finditer("\n", text)] + [len(text)]
    spans = list(zip([0, *(e + 1 for e in ends)], ends))
    return [spans[k] for column in _columns(len(spans), left, right, columns) for k in column]


def reading_text(text: str, left: list[int] | None, right: list[int] | None, columns: int | None) -> str:
    """The page in reading order, with words that were broken at line ends joined."""
    if columns and columns > 1:
        lines = text.split("\n")
        text = "\n".join(lines[k] for column in _columns(len(lines), left, right, columns) for k in column)
    return _BREAK.sub("", text)
