"""Exact order statistics with bounded memory, and small numeric helpers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

# Up to this many values (rows x columns) the built-in exact percentile is used:
# its state, one entry per distinct value, is held by a single task.
SMALL_VALUES = 2_000_000
# A gap between cut points with at most this many rows is read to the driver.
GAP_ROWS = 5_000
_ACCURACY = 10_000
_MARGIN = 2.0 / _ACCURACY


def clean_double(col: Column) -> Column:
    """Cast to double with NaN and infinities turned into NULL."""
    x = col.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def bucketed(df: DataFrame, edges: dict[str, list[float]], outputs: dict[str, str], equal: bool = False) -> DataFrame:
    """Adds the number of edges under each value (a binary search in the JVM).

    With ``equal`` the number is twice that, plus one for a value on an edge.
    NULL values keep a number of their own; filter them by the value.
    """
    splits = {}
    for c, cuts in edges.items():
        points: list[float] = []
        for e in sorted(set(cuts)):
            for p in ((e, math.nextafter(e, math.inf)) if equal else (math.nextafter(e, math.inf),)):
                points.append(p)
        splits[c] = [-math.inf, *points, math.inf]
    cols = list(edges)
    return Bucketizer(splitsArray=[splits[c] for c in cols], inputCols=cols, outputCols=[outputs[c] for c in cols],
                      handleInvalid="keep").transform(df)


def exact_quantiles(
    df: DataFrame,
    exprs: dict[str, Column],
    probs: list[float],
    small_values: int | None = None,
    rows_at_most: int | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each expression, NULLs skipped.

    Small inputs use ``percentile``. Larger ones close in on each order
    statistic: a mergeable sketch proposes cut points, one pass counts the rows
    between them exactly, and the loop repeats inside the gap that holds the
    rank until few rows are left there. No task ever holds more than a sketch,
    and a value that fills a gap settles it at once. ``rows_at_most`` is the
    caller's bound on the rows; without one the input counts as large.
    """
    limit = SMALL_VALUES if small_values is None else small_values
    if not exprs:
        return {}
    names = list(exprs)
    # Adding 0 makes negative zero zero.
    work = df.select(*[(clean_double(exprs[k]) + 0.0).alias(f"q{i}") for i, k in enumerate(names)])
    if rows_at_most is not None and rows_at_most * len(names) <= limit:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        row = work.agg(*[F.percentile(f"q{i}", grid).alias(f"q{i}") for i in range(len(names))]).first()
        return {k: list(row[i]) if row[i] is not None else [None] * len(probs)
                for i, k in enumerate(names)}
    return dict(zip(names, _closing_in(_Columns(work, len(names)), probs, GAP_ROWS)[0]))


def group_quantiles(df: DataFrame, group: Column, groups: int, value: Column, probs: list[float],
                    extra: dict[str, Column] | None = None, gap_rows: int | None = None) -> tuple[list[list[float | None]], list[dict]]:
    """Quantiles of ``value`` for each of the few groups 0 to ``groups`` - 1, and further aggregates
    of the column ``v``, taken in the first pass.

    All groups close in on their order statistics together, by counts between cut
    points of their own, so neither sorted nor written rows are needed and ``df`` is
    read some three times. NULL, NaN and infinite values are skipped.
    """
    work = df.select(group.cast("int").alias("c"), (clean_double(value) + 0.0).alias("v")).where(F.col("v").isNotNull())
    return _closing_in(_Groups(work, groups, extra or {}), probs, gap_rows or max(1, GAP_ROWS // max(1, groups)))


class _Columns:
    """The numbers of several columns, q0 onward, side by side."""

    def __init__(self, work: DataFrame, n: int):
        self.work, self.n = work, n

    def first(self, sides: list[float]) -> tuple[list[int], list[list], list[dict]]:
        row = self.work.agg(*[e for i in range(self.n) for e in (
            F.count(f"q{i}").alias(f"n{i}"), _sketch(F.col(f"q{i}"), sides).alias(f"g{i}"))]).first()
        return [row[f"n{i}"] for i in range(self.n)], [row[f"g{i}"] for i in range(self.n)], [{}] * self.n

    def binned(self, cuts: list[list[float]]) -> DataFrame:
        return _binned(self.work, cuts)

    def inside(self, i: int, g: _Gap) -> Column:
        x = F.col(f"q{i}")
        return F.when(_inside(x, g), x)


class _Groups:
    """The numbers of several groups, one under another: (c, v)."""

    def __init__(self, work: DataFrame, n: int, extra: dict[str, Column]):
        self.work, self.n, self.extra = work, n, extra

    def first(self, sides: list[float]) -> tuple[list[int], list[list], list[dict]]:
        rows = {r["c"]: r.asDict() for r in self.work.groupBy("c").agg(
            F.count(F.lit(1)).alias("_n"), _sketch(F.col("v"), sides).alias("_g"),
            *[e.alias(k) for k, e in self.extra.items()]).collect()}       # one row per group
        got = [rows.get(i, {}) for i in range(self.n)]
        return [r.get("_n", 0) for r in got], [r.get("_g") for r in got], got

    def binned(self, cuts: list[list[float]]) -> DataFrame:
        own = F.get(F.array(*[F.array(*[F.lit(c) for c in per]).cast("array<double>") for per in cuts]), F.col("c"))
        place = F.size(F.filter("_own", lambda c: c < F.col("v"))) + F.size(F.filter("_own", lambda c: c <= F.col("v")))
        return self.work.withColumn("_own", own).where(F.size("_own") > 0).select("c", "v", place.alias("bin"))

    def inside(self, i: int, g: _Gap) -> Column:
        return F.when((F.col("c") == i) & _inside(F.col("v"), g), F.col("v"))


@dataclass(frozen=True)
class _Gap:
    """Rows strictly between two cut points: ``before`` rows lie at or under the
    lower one, ``inside`` between them."""

    low: float
    high: float
    before: int
    inside: int


def _closing_in(source: _Columns | _Groups, probs: list[float], gap_rows: int) -> tuple[list[list[float | None]], list[dict]]:
    # The first pass counts and sketches at once: ranks are shares of a count not known yet.
    sides = sorted({min(max(p + side, 0.0), 1.0) for p in probs for side in (-_MARGIN, _MARGIN)})
    counts, sketched, extra = source.first(sides)
    cuts = [_apart(sorted(set(g or []))) for g in sketched]
    wanted: dict[tuple[int, int], tuple[int, int, float]] = {}
    for i, n in enumerate(counts):
        for j, p in enumerate(probs):
            h = (n - 1) * p
            if n:
                wanted[(i, j)] = (math.floor(h), min(math.floor(h) + 1, n - 1), h - math.floor(h))
    ranks = [{r for (i, _), (lo, hi, _) in wanted.items() if i == c for r in (lo, hi)} for c in range(source.n)]
    found: list[dict[int, float]] = [{} for _ in counts]
    gaps: list[dict[_Gap, set[int]]] = [
        {_Gap(-math.inf, math.inf, 0, n): r} if r else {} for r, n in zip(ranks, counts)]
    while any(gaps):
        tallies = _tally(source, cuts)
        gaps = [_narrow(g, cuts[i], tallies[i], found[i]) for i, g in enumerate(gaps)]
        small = [{g: r for g, r in per.items() if g.inside <= gap_rows} for per in gaps]
        if any(small):
            _read_gaps(source, small, found)
        gaps = [{g: r for g, r in per.items() if g.inside > gap_rows} for per in gaps]
        if any(gaps):
            cuts = _propose(source, gaps)
    out: list[list[float | None]] = [[None] * len(probs) for _ in counts]
    for (i, j), (lo, hi, frac) in wanted.items():
        a, b = found[i][lo], found[i][hi]
        out[i][j] = a + (b - a) * frac
    return out, extra


def _sketch(x: Column, probs: list[float]) -> Column:
    return F.percentile_approx(x, F.array(*[F.lit(p) for p in probs]), _ACCURACY)


def _inside(x: Column, g: _Gap) -> Column:
    return (x > F.lit(g.low)) & (x < F.lit(g.high))


def _binned(work: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """(c, v, bin): bin 2k lies under cut k (and over cut k-1), bin 2k+1 equals it."""
    live = [i for i, c in enumerate(cuts) if c]
    cut = bucketed(work, {f"q{i}": cuts[i] for i in live}, {f"q{i}": f"b{i}" for i in live}, equal=True)
    pairs = cut.select(*[F.struct(F.col(f"q{i}").alias("v"), F.col(f"b{i}").cast("int").alias("bin")).alias(f"b{i}")
                         for i in live])
    tall = pairs.unpivot([], [f"b{i}" for i in live], "c", "b")
    return tall.select(F.substring("c", 2, 9).cast("int").alias("c"), "b.v", "b.bin").where(F.col("v").isNotNull())


def _tally(source: _Columns | _Groups, cuts: list[list[float]]) -> list[dict[int, int]]:
    """Exact rows per bin and column."""
    out: list[dict[int, int]] = [{} for _ in cuts]
    if any(cuts):
        for r in source.binned(cuts).groupBy("c", "bin").count().collect():
            out[r["c"]][r["bin"]] = r["count"]
    return out


def _read_gaps(source: _Columns | _Groups, gaps: list[dict[_Gap, set[int]]], found: list[dict[int, float]]) -> None:
    """Read the few rows of each gap, counted per value, and pick the ranks."""
    edges = [sorted({e for g in per for e in (g.low, g.high) if math.isfinite(e)}) or ([0.0] if per else [])
             for per in gaps]
    hit = F.lit(False)
    for i, per in enumerate(gaps):
        bins = set()
        for g in per:
            k = edges[i].index(g.high) if math.isfinite(g.high) else len(edges[i])
            bins.add(2 * k)
            if not math.isfinite(g.low) and not math.isfinite(g.high):
                bins.update((0, 1, 2))
        if bins:
            hit = hit | ((F.col("c") == i) & F.col("bin").isin(sorted(bins)))
    rows = source.binned(edges).where(hit).groupBy("c", "v").count().collect()
    values: list[list] = [[] for _ in gaps]
    for r in rows:
        values[r["c"]].append((r["v"], r["count"]))
    for i, per in enumerate(gaps):
        ordered = sorted(values[i])
        for g, ranks in per.items():
            seen, todo = g.before, sorted(ranks)
            for v, n in ordered:
                if g.low < v < g.high:
                    seen += n
                    while todo and todo[0] < seen:
                        found[i][todo.pop(0)] = v


def _propose(source: _Columns | _Groups, gaps: list[dict[_Gap, set[int]]]) -> list[list[float]]:
    """Sorted cut points per column: a sketch's values just beside each rank."""
    aggs, owner = [], []
    for i, per in enumerate(gaps):
        for g, ranks in per.items():
            shares = [(r - g.before + 0.5) / g.inside for r in ranks]
            probs = sorted({min(max(s + side, 0.0), 1.0) for s in shares for side in (-_MARGIN, _MARGIN)})
            aggs.append(_sketch(source.inside(i, g), probs).alias(f"g{len(aggs)}"))
            owner.append(i)
    row = source.work.agg(*aggs).first()
    cuts: list[set[float]] = [set() for _ in gaps]
    for i, values in zip(owner, row):
        cuts[i].update(values)
    return [_apart(sorted(c)) for c in cuts]


def _apart(cuts: list[float]) -> list[float]:
    """Cuts with at least one number between neighbours, so that bins stay in order."""
    out: list[float] = []
    for c in cuts:
        if not out or c > math.nextafter(out[-1], math.inf):
            out.append(c)
    return out


def _narrow(gaps: dict[_Gap, set[int]], cuts: list[float], tally: dict[int, int],
            found: dict[int, float]) -> dict[_Gap, set[int]]:
    """Settle ranks that fall on a cut; put the others in the gaps between cuts."""
    out: dict[_Gap, set[int]] = {}
    for g, ranks in gaps.items():
        for rank in ranks:
            seen, low = 0, -math.inf
            for k in range(len(cuts) + 1):
                under, on = tally.get(2 * k, 0), tally.get(2 * k + 1, 0)
                if rank < seen + under:
                    high = cuts[k] if k < len(cuts) else math.inf
                    # Rows of the column between two cuts of this pass, within the gap of the last one.
                    lo, hi = max(low, g.low), min(high, g.high)
                    before = seen if low >= g.low else g.before
                    end = seen + under if high <= g.high else g.before + g.inside
                    out.setdefault(_Gap(lo, hi, before, end - before), set()).add(rank)
                    break
                if rank < seen + under + on:
                    found[rank] = cuts[k]
                    break
                seen += under + on
                low = cuts[k] if k < len(cuts) else low
    return out


def medians(df: DataFrame, exprs: dict[str, Column], **kw) -> dict[str, float | None]:
    return {k: v[0] for k, v in exact_quantiles(df, exprs, [0.5], **kw).items()}


def even_bucket(ord_col: Column, n: int, k: int) -> Column:
    """0-based bucket of a position when n rows are cut into k near-equal runs,
    the first n % k runs one row longer."""
    size, extra = divmod(n, k)
    head = extra * (size + 1)
    first = F.floor(ord_col / F.lit(size + 1))
    if size == 0:
        return first
    rest = F.floor((ord_col - F.lit(head)) / F.lit(size)) + F.lit(extra)
    return F.when(ord_col < head, first).otherwise(rest).cast("int")


def floor_segment(ord_col: Column, n: int, k: int) -> Column:
    """0-based segment of a position when the bounds are floor(i * n / k)."""
    return F.floor(((ord_col + 1) * F.lit(k) - 1) / F.lit(n)).cast("int")
