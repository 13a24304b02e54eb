"""Exact order statistics without a sort and without an unbounded buffer.

The built-in exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer.  Here a rank is bracketed instead: a KLL sketch names two data
values around it, one counting aggregate says exactly how many values lie below
and at them, and the bracket shrinks by a factor of several hundred per round
until its values fit a small sorted list.  The counts include the bracket ends
themselves, so a very frequent value is found at once.  The sketch only steers
the search; the counts decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLECT = 50_000
SKETCH_SIZE = 16_384
TARGETS_PER_JOB = 32
CELLS = 1024


@dataclass
class _Target:
    col: str
    rank: int  # 0-based rank among the non-null values
    inside: int  # values in the open bracket (low, high); None is unbounded
    low: float | None = None
    high: float | None = None
    below: int = 0  # values <= low
    value: float | None = None

    def bracket(self):
        return self.col, self.low, self.high

    def members(self):
        c = F.col(self.col)
        keep = c.isNotNull()
        if self.low is not None:
            keep = keep & (c > F.lit(self.low))
        if self.high is not None:
            keep = keep & (c < F.lit(self.high))
        return F.when(keep, c)


def _margin(sketch_size: int) -> float:
    """A little more than the published rank error of the sketch."""
    return 6.0 / sketch_size**0.9


def sketch(df: DataFrame, col: str, value: Column, size: int) -> tuple[Column, object]:
    """The sketch aggregate of a numeric column and the function that reads quantiles from it."""
    if isinstance(df.schema[col].dataType, T.IntegralType):
        return F.kll_sketch_agg_bigint(value.cast("long"), size), F.kll_sketch_get_quantile_bigint
    return F.kll_sketch_agg_double(value.cast("double"), size), F.kll_sketch_get_quantile_double


def fractions(values) -> Column:
    return F.array(*[F.lit(min(1.0, max(0.0, v))) for v in values])


def order_statistics(
    df: DataFrame,
    ranks: dict[str, list[int]],
    n: dict[str, int],
    collect_limit: int = COLLECT,
    sketch_size: int = SKETCH_SIZE,
    hints: dict[tuple[str, int], tuple[float, float]] | None = None,
) -> dict[str, dict[int, float]]:
    """The values at the given 0-based ranks of each column, exactly.

    ``n`` is the number of non-null values per column.  ``hints`` may name two
    values around a rank, which saves the first sketch.
    """
    targets = [_Target(c, r, n[c]) for c, rs in ranks.items() for r in sorted(set(rs))]
    for t in targets:
        if not 0 <= t.rank < t.inside:
            raise ValueError(f"rank {t.rank} outside 0..{t.inside - 1} of {t.col}")
    todo = targets
    while todo:
        # A job reads only the columns of its own targets, so splitting wide tables
        # over several jobs reads no column twice and keeps each plan small.
        for part in _parts([t for t in todo if t.inside <= collect_limit]):
            _finish(df, part)
        for part in _parts([t for t in todo if t.inside > collect_limit]):
            _tally(df, _hinted(part, hints) if hints else _sketched(df, part, sketch_size))
        hints = None
        todo = [t for t in todo if t.value is None]
    out: dict[str, dict[int, float]] = {}
    for t in targets:
        out.setdefault(t.col, {})[t.rank] = t.value
    return out


def _parts(targets):
    return [targets[k:k + TARGETS_PER_JOB] for k in range(0, len(targets), TARGETS_PER_JOB)]


def _by_bracket(targets):
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault(t.bracket(), []).append(t)
    return list(groups.values())


def _finish(df, targets):
    # at most COLLECT values per bracket, sorted inside one aggregation buffer
    groups = _by_bracket(targets)
    lists = [F.sort_array(F.collect_list(g[0].members())).alias(f"v{k}") for k, g in enumerate(groups)]
    picks = [F.array(*[F.get(f"v{k}", F.lit(t.rank - t.below)) for t in g]) for k, g in enumerate(groups)]
    row = df.agg(*lists).select(*[p.alias(f"p{k}") for k, p in enumerate(picks)]).head()
    for k, g in enumerate(groups):
        for t, value in zip(g, row[f"p{k}"], strict=True):
            t.value = value


def _hinted(targets, hints):
    ends: dict[tuple, list[_Target]] = {}
    for t in targets:
        ends.setdefault((t.col, *hints[t.col, t.rank]), []).append(t)
    return [(ts, a, b) for (_, a, b), ts in ends.items()]


def _sketched(df, targets, size):
    margin = _margin(size)
    sketches, reads, clusters = [], [], []
    for k, g in enumerate(_by_bracket(targets)):
        # neighbouring ranks share one pair of bracket ends
        near: list[list[_Target]] = []
        for t in g:
            if near and t.rank - near[-1][-1].rank <= 1:
                near[-1].append(t)
            else:
                near.append([t])
        probs = []
        for ts in near:
            first, last = ((t.rank - t.below + 0.5) / t.inside for t in (ts[0], ts[-1]))
            probs += [first - margin, last + margin]
        agg, read = sketch(df, g[0].col, g[0].members(), size)
        sketches.append(agg.alias(f"s{k}"))
        reads.append(read(f"s{k}", fractions(probs)).alias(f"q{k}"))
        clusters += [(k, i, ts) for i, ts in enumerate(near)]
    found = df.agg(*sketches).select(*reads).head()
    return [(ts, found[f"q{k}"][2 * i], found[f"q{k}"][2 * i + 1]) for k, i, ts in clusters]


def _tally(df, ends):
    """Count below and at the bracket ends and keep the part that holds each rank."""
    tallies = []
    for k, (ts, a, b) in enumerate(ends):
        c = F.col(ts[0].col)
        tests = (c < F.lit(a), c <= F.lit(a), c < F.lit(b), c <= F.lit(b))
        tallies += [F.count_if(test).alias(f"c{k}_{j}") for j, test in enumerate(tests)]
    row = df.agg(*tallies).head()
    for k, (ts, a, b) in enumerate(ends):
        lt_a, le_a, lt_b, le_b = (row[f"c{k}_{j}"] for j in range(4))
        for t in ts:
            if t.rank < lt_a:
                t.high, t.inside = a, lt_a - t.below
            elif t.rank < le_a:
                t.value = a
            elif t.rank < lt_b:
                t.low, t.high, t.below, t.inside = a, b, le_a, lt_b - le_a
            elif t.rank < le_b:
                t.value = b
            else:
                t.low, t.below, t.inside = b, le_b, t.inside - (le_b - t.below)


def exact_quantiles(
    df: DataFrame, probs: dict[str, list[float]], collect_limit: int = COLLECT, sketch_size: int = SKETCH_SIZE
) -> dict[str, list[float]]:
    """Quantiles with linear interpolation for every column of ``probs``; nulls and NaN are left out.

    The first scan counts, finds the extremes and sketches all columns at once.
    """
    margin = _margin(sketch_size)
    df = df.select(*[_without_nan(df, c) for c in probs])
    aggs, reads = [], []
    for k, c in enumerate(probs):
        agg, read = sketch(df, c, F.col(c), sketch_size)
        aggs += [F.count(c).alias(f"n{k}"), F.min(c).alias(f"a{k}"), F.max(c).alias(f"b{k}"), agg.alias(f"s{k}")]
        around = fractions(v for q in probs[c] for v in (q - margin, q + margin))
        reads += [f"n{k}", f"a{k}", f"b{k}", F.when(F.col(f"n{k}") > 0, read(f"s{k}", around)).alias(f"q{k}")]
    first = df.agg(*aggs).select(*reads).head()
    n, known, places, hints = {}, {}, {}, {}
    for k, c in enumerate(probs):
        n[c] = first[f"n{k}"]
        if n[c] == 0:
            raise ValueError(f"no values in {c}")
        known[c] = {0: first[f"a{k}"], n[c] - 1: first[f"b{k}"]}
        places[c] = []
        for i, q in enumerate(probs[c]):
            pos = q * (n[c] - 1)
            places[c].append((pos, math.floor(pos), math.ceil(pos)))
            for r in places[c][-1][1:]:
                hints[c, r] = (first[f"q{k}"][2 * i], first[f"q{k}"][2 * i + 1])
    wanted = {c: [r for _, lo, hi in places[c] for r in (lo, hi) if r not in known[c]] for c in probs}
    for c, values in order_statistics(df, wanted, n, collect_limit, sketch_size, hints).items():
        known[c].update(values)
    out = {}
    for c in probs:
        out[c] = []
        for pos, lo, hi in places[c]:
            a, b = float(known[c][lo]), float(known[c][hi])
            out[c].append(a if a == b else a + (b - a) * (pos - lo))
    return out


def _without_nan(df, c):
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), F.col(c)).alias(c)
    return F.col(c)


def rank_by_cells(
    df: DataFrame, cols: list[str], rank: int, n: int, guess: dict[str, tuple[float, float]],
    cells: int = CELLS, collect_limit: int = COLLECT,
) -> dict[str, float]:
    """The value at one 0-based rank of each of several columns without nulls.

    For smooth values with a guessed range, such as distances: each scan counts
    ``cells`` equal cells of the range and keeps the extremes of every cell, so
    the cell that holds the rank becomes the next range exactly, also when the
    guess was wrong.
    """
    out: dict[str, float] = {}
    spans = {c: (None, None, 0, n) for c in cols}  # closed range, values below it, values in it
    while len(out) < len(cols):
        todo = [c for c in cols if c not in out]

        def member(c):
            low, high, _, _ = spans[c]
            return F.lit(True) if low is None else F.col(c).between(F.lit(low), F.lit(high))

        few = [c for c in todo if spans[c][3] <= collect_limit]
        if few:
            lists = [F.sort_array(F.collect_list(F.when(member(c), F.col(c)))).alias(c) for c in few]
            row = df.agg(*lists).select(*[F.get(c, F.lit(rank - spans[c][2])).alias(c) for c in few]).head()
            out.update({c: row[c] for c in few})
        many = [c for c in todo if c not in out]
        if not many:
            continue
        parts = []
        for k, c in enumerate(many):
            low, high, _, _ = spans[c]
            first, last = guess[c] if low is None else (low, high)
            cell = F.width_bucket(F.col(c), F.lit(float(first)), F.lit(float(last)), F.lit(cells))
            parts += [F.lit(k), F.when(member(c), cell), F.col(c)]
        tall = df.select(F.stack(F.lit(len(many)), *parts).alias("k", "cell", "v")).where("cell is not null")
        rows = tall.groupBy("k", "cell").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for k, c in enumerate(many):
            below = spans[c][2]
            for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["cell"]):
                if rank < below + r["n"]:
                    break
                below += r["n"]
            spans[c] = (r["low"], r["high"], below, r["n"])
            if r["low"] == r["high"]:
                out[c] = r["low"]
    return out
