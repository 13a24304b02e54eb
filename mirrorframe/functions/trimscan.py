"""Moments of the rows closest to a centre, found in the scan that looks for their distance.

A step of a trimmed estimator needs the h-th smallest distance and the moments of
the rows below it.  One scan counts distances in fine cells and adds up the moments of
the rows in a few coarse cells around the cut of the step before.  The counts name
the fine cell that holds the cut, the moments of the coarse cells below it are known by then, and a
second scan looks at the rows between them and in that cell alone: where these are few, the
rows themselves come to the driver.  Only beyond some ten million rows, or after a
guess that was far off, does it take a third scan.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mirrorframe.functions.rankscan import merge_in_levels
from mirrorframe.functions.vectors import matrices

#: Fine cells of a scan, and the octaves on either side of a guess that they cover (without a guess: more).
FINE, OCTAVES, WIDE_OCTAVES = 4096, 1.0, 8.0
#: Coarse cells span this range around a guess; the numbers in their moments are bounded.
SPAN, MOMENT_NUMBERS, COARSE = 1.25, 1 << 20, 16
#: Numbers in the rows that a scan may send to the driver, for each state.
ROW_NUMBERS = 1 << 17
#: Relative width of a tie: distances this close to the cut count as equal to it.
TIE = 1e-12

Moments = tuple[float, np.ndarray, np.ndarray]


def add_moments(a: Moments | None, b: Moments | None) -> Moments | None:
    """Moments (n, mean, centred second) of two sets of rows together."""
    if a is None or b is None or not a[0] or not b[0]:
        return b if a is None or not a[0] else a
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def moments_of(y: np.ndarray) -> Moments | None:
    if not len(y):
        return None
    mean = y.mean(axis=0)
    c = y - mean
    return float(len(y)), mean, c.T @ c


@dataclass
class _Look:
    """What a scan does for one state: moments between neighbouring edges, counts of cells, rows or moments of a range."""

    edges: list[float]
    cells: tuple | None = None  # ("log", guess, octaves) or ("even", low, high)
    rows: tuple[float, float] | None = None
    ties: tuple[float, float] | None = None


@dataclass
class _Found:
    between: list[Moments | None]
    cells: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # numbers, minima, maxima
    rows: list[np.ndarray] = field(default_factory=list)
    ties: Moments | None = None


def _cell_of(d: np.ndarray, cells: tuple) -> np.ndarray:
    """The cell of each distance; it never falls where distances rise."""
    kind, a, b = cells
    with np.errstate(divide="ignore"):
        at = (np.log2(d / a) + b) * (FINE / (2 * b)) if kind == "log" else (d - a) * (FINE / (b - a))
    return np.clip(np.floor(np.maximum(at, -1.0)), -1, FINE).astype(np.int64) + 1


def _empty_cells():
    return np.zeros(FINE + 2, np.int64), np.full(FINE + 2, np.inf), np.full(FINE + 2, -np.inf)


def _look(look: _Look, found: _Found, y: np.ndarray, d: np.ndarray) -> None:
    order = np.argsort(d)
    d = d[order]
    at = np.searchsorted(d, look.edges)
    for k in range(len(look.edges) - 1):
        found.between[k] = add_moments(found.between[k], moments_of(y[order[at[k] : at[k + 1]]]))
    if look.cells:
        inside = d if look.cells[0] == "log" else d[(d >= look.cells[1]) & (d <= look.cells[2])]
        if len(inside):
            cell = _cell_of(inside, look.cells)
            first = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
            n, low, high = found.cells
            cell, last = cell[first], np.append(first[1:], len(inside)) - 1
            n[cell] += last - first + 1
            low[cell], high[cell] = np.minimum(low[cell], inside[first]), np.maximum(high[cell], inside[last])
    for name, span in (("rows", look.rows), ("ties", look.ties)):
        if span:
            a, b = np.searchsorted(d, span[0], "left"), np.searchsorted(d, span[1], "right")
            if name == "rows" and b > a:
                found.rows.append(np.column_stack([d[a:b], y[order[a:b]]]))
            elif name == "ties":
                found.ties = add_moments(found.ties, moments_of(y[order[a:b]]))


def _join(a: _Found, b: _Found) -> _Found:
    cells = None if a.cells is None else (a.cells[0] + b.cells[0], np.minimum(a.cells[1], b.cells[1]), np.maximum(a.cells[2], b.cells[2]))
    return _Found([add_moments(x, y) for x, y in zip(a.between, b.between, strict=True)], cells, a.rows + b.rows, add_moments(a.ties, b.ties))


def _scan(blocks: DataFrame, distances: Callable, looks: list[_Look]) -> list[_Found]:
    """Look at all rows once, for several states; ``distances`` maps a batch to (rows, distances of each state)."""

    def start():
        return [_Found([None] * (len(look.edges) - 1), _empty_cells() if look.cells else None) for look in looks]

    def packed(found):
        plain = [(f.between, f.cells, f.rows, f.ties) for f in found]
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(plain)], pa.binary())], names=["found"])

    def unpacked(value):
        return [_Found(*f) for f in pickle.loads(value)]

    def fold(batches):
        found = start()
        for batch in batches:
            for x in matrices(batch):
                y, d = distances(x)
                for k, look in enumerate(looks):
                    _look(look, found[k], y, d[:, k])
        yield packed(found)

    def merge(batches):
        found = None
        for batch in batches:
            for value in batch.column("found"):
                own = unpacked(value.as_py())
                found = own if found is None else [_join(a, b) for a, b in zip(found, own, strict=True)]
        if found is not None:
            yield packed(found)

    states = merge_in_levels(blocks.mapInArrow(fold, "found BINARY"), lambda df: df.mapInArrow(merge, "found BINARY"))
    out = start()
    for row in states.collect():
        out = [_join(a, b) for a, b in zip(out, unpacked(bytes(row["found"])), strict=True)]
    return out


class _Search:
    """One state on its way to the moments of its h closest rows."""

    def __init__(self, h: int, q: int, guess: float | None):
        self.h, self.q = h, q
        self.inside: Moments | None = None  # of the rows known to be below the cut
        self.done: tuple[np.ndarray, np.ndarray, float] | None = None
        self.span = (0.0, np.inf)
        if guess is None or not guess > 0:
            self.look = _Look([0.0], ("log", float(q), WIDE_OCTAVES))
        else:
            coarse = max(2, min(COARSE, MOMENT_NUMBERS // (q * q)))
            self.look = _Look([0.0, *np.geomspace(guess / SPAN, guess * SPAN, coarse + 1).tolist()], ("log", guess, OCTAVES))

    def take(self, found: _Found) -> None:
        if self.look.cells is None:
            self._finish(found)
            return
        n, low, high = found.cells
        base = 0 if self.look.cells[0] == "log" else int(self._known(found)[0])
        passed = base + np.cumsum(n)
        cell = int(np.searchsorted(passed, self.h - 1, side="right"))
        if cell >= len(n):
            raise ValueError(f"{self.h} rows asked for, {int(passed[-1])} there")
        a, b = float(low[cell]) * (1 - 4 * TIE), float(high[cell]) * (1 + 4 * TIE)
        # what lies between the edges up to the cell is known; the rest is looked at again
        edge = int(np.searchsorted(self.look.edges, a, side="right")) - 1
        for k in range(edge):
            self.inside = add_moments(self.inside, found.between[k])
        begin = self.look.edges[edge]
        if low[cell] == high[cell]:
            self.look = _Look([begin, a], ties=(a, b))
        elif int(n[cell]) * (self.q + 1) <= ROW_NUMBERS:
            self.look = _Look([begin, a], rows=(a, b))
        else:
            self.look = _Look([begin, a], ("even", a, b))

    def _known(self, found: _Found) -> Moments:
        """Everything below the range of this look."""
        known = self.inside
        for m in found.between:
            known = add_moments(known, m)
        return known if known is not None else (0.0, np.zeros(self.q), np.zeros((self.q, self.q)))

    def _finish(self, found: _Found) -> None:
        below = self._known(found)
        if self.look.ties:
            cut, tied = self.look.ties[1] / (1 + 4 * TIE), found.ties
        else:
            rows = np.vstack(found.rows) if found.rows else np.zeros((0, self.q + 1))
            d = rows[:, 0]
            cut = float(np.sort(d)[self.h - 1 - int(below[0])])
            under = d < cut * (1 - TIE)
            below = add_moments(below, moments_of(rows[under, 1:]))
            tied = moments_of(rows[~under & (d <= cut * (1 + TIE)), 1:])
        (n0, m0, s0), (n1, m1, s1) = below, tied
        share, w, gap = (self.h - n0) / n1, self.h - n0, m1 - m0
        mean = m0 + gap * (w / self.h) if n0 else m1
        spread = (s0 + share * s1 + (np.outer(gap, gap) * (n0 * w / self.h) if n0 else 0.0)) / self.h
        self.done = mean, spread, cut


def closest_moments(blocks: DataFrame, distances: Callable, q: int, h: int, guesses: list[float | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[float], int]:
    """(mean, scatter) of the ``h`` closest rows of every state, the cuts of their distances, and the number of scans.

    Rows tied at the cut share what is left of ``h`` evenly, so the result depends on no
    order of the rows.  ``guesses`` are where the cuts may be; they decide the number of
    scans, not the result.
    """
    states = [_Search(h, q, g) for g in guesses]
    scans = 0
    while any(s.done is None for s in states):
        todo = [k for k, s in enumerate(states) if s.done is None]

        def chosen(x, todo=tuple(todo)):
            y, d = distances(x)
            return y, d[:, list(todo)]

        for k, found in zip(todo, _scan(blocks, chosen, [states[k].look for k in todo]), strict=True):
            states[k].take(found)
        scans += 1
    return [s.done[:2] for s in states], [s.done[2] for s in states], scans
