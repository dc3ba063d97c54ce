"""The distributed time axis: ordinals, chunks with a halo, and carries.

A single series has one global order, yet nothing here runs a window over the
whole of it. Rows get a dense ordinal from a range sort; backward-looking work
runs in chunks of the ordinal that also receive the last rows of the chunk
before; work that looks back without bound passes one value per chunk onward.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tideframe import staging
from tideframe.functions.names import q

ORD = "ord"
MAX_CHUNK = 65_536
MIN_CHUNK = 1_024
# Per-chunk carry tables up to this many cells are broadcast.
BROADCAST_CELLS = 1_000_000

_SLOT, _PART = "_slot", "_part"
_LOCAL_BITS = 33          # monotonically_increasing_id keeps the row in the low 33 bits


@dataclass(frozen=True)
class Series:
    """A time-ordered table: ``df`` holds ``ts``, the ordinal ``ord`` and the data."""

    df: DataFrame
    n: int
    ts: str = "ts"
    chunk: int | None = None

    def with_df(self, df: DataFrame, n: int | None = None) -> "Series":
        return replace(self, df=df, n=self.n if n is None else n)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (self.ts, ORD)]

    def chunk_rows(self, halo: int = 0) -> int:
        if self.chunk:
            return max(self.chunk, halo, 1)
        return chunk_rows(self.df, self.n, halo)


def chunk_rows(df: DataFrame, n: int, halo: int = 0) -> int:
    """Rows per chunk: several chunks per core, within bounds, and ten halos long."""
    slots = 4 * df.sparkSession.sparkContext.defaultParallelism
    even = math.ceil(max(n, 1) / slots)
    return max(min(max(even, MIN_CHUNK), MAX_CHUNK), 10 * halo)


def _range_sorted(df: DataFrame, order_by: list[str], label: str) -> tuple[DataFrame, Column]:
    """Store ``df`` range-sorted; return it and its range number."""
    placed = (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
              .withColumn(_SLOT, F.monotonically_increasing_id()))
    stored = staging.store(placed, label)
    part = F.shiftright(F.col(_SLOT), _LOCAL_BITS)
    return stored, part


def _offsets(df: DataFrame, rows: list[tuple], names: list[str], zero: int | float = 0) -> DataFrame:
    """Prefix sums over ranges, one row per range (at most one per shuffle partition)."""
    running = [zero] * len(names)
    out = []
    for part, *values in sorted(rows):
        out.append((part, *running))
        running = [a + (b or zero) for a, b in zip(running, values)]
    schema = f"{_PART} bigint, " + ", ".join(names)
    return df.sparkSession.createDataFrame(out, schema)


def ordinal(
    df: DataFrame, order_by: list[str], ts: str = "ts", name: str = ORD, chunk: int | None = None,
    settled: bool = False,
) -> Series:
    """Number rows 0..n-1 by ``order_by``, which must be unique for a repeatable result.

    The sorted rows are written to the shared folder first: partition numbers
    are only trusted once they are data, so recomputation cannot change them.
    ``settled`` writes the numbered rows as well (no shuffle): a table that many
    folds read then skips the row groups outside an ordinal range.
    """
    stored, part = _range_sorted(df.drop(name), order_by, "ordinal")
    sizes = [(r[0], r[1]) for r in stored.groupBy(part.alias(_PART)).count().collect()]
    offsets = _offsets(df, sizes, ["_before bigint"])
    local = F.col(_SLOT).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    numbered = (stored.withColumn(_PART, part)
                .join(F.broadcast(offsets), _PART)
                .withColumn(name, F.col("_before") + local)
                .drop(_PART, _SLOT, "_before"))
    if settled:
        numbered = staging.store(numbered, "ordinal")
    return Series(numbered, sum(s for _, s in sizes), ts, chunk)


def running_totals(df: DataFrame, order_by: list[str], totals: dict[str, str]) -> DataFrame:
    """Inclusive running sums ``totals`` = {new column: summed column} along ``order_by``."""
    stored, part = _range_sorted(df, order_by, "running")
    keys = list(totals)
    sums = [tuple(r) for r in stored.groupBy(part.alias(_PART)).agg(
        *[F.sum(F.col(q(totals[k])).cast("double")).alias(k) for k in keys]).collect()]
    offsets = _offsets(df, sums, [f"`_before_{k}` double" for k in keys], 0.0)
    w = Window.partitionBy(_PART).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    out = stored.withColumn(_PART, part).join(F.broadcast(offsets), _PART)
    out = out.select("*", *[(F.col(q(f"_before_{k}")) + F.sum(F.col(q(totals[k])).cast("double")).over(w)).alias(k)
                            for k in keys])
    return out.drop(_PART, _SLOT, *[f"_before_{k}" for k in keys])


def rebase(series: Series, lo: int, hi: int | None = None) -> Series:
    """Keep ordinals in [lo, hi) and renumber them from zero."""
    hi = series.n if hi is None else min(hi, series.n)
    lo = min(max(lo, 0), hi)
    df = series.df.where((F.col(ORD) >= lo) & (F.col(ORD) < hi)).withColumn(ORD, F.col(ORD) - F.lit(lo))
    return series.with_df(df, hi - lo)


def in_range(lo: int, hi: int) -> Column:
    return (F.col(ORD) >= lo) & (F.col(ORD) < hi)


def haloed(df: DataFrame, chunk: int, before: int = 0, after: int = 0) -> tuple[DataFrame, WindowSpec, Column]:
    """Chunks with copies of neighbouring rows.

    Returns the copied rows, the window to use, and the filter that keeps each
    row once. ``before``/``after`` rows on either side are visible in a chunk.
    """
    if max(before, after) > chunk:
        raise ValueError("the halo is longer than a chunk")
    own = F.floor(F.col(ORD) / F.lit(chunk))
    place = F.col(ORD) % F.lit(chunk)
    homes = [own]
    if before:
        homes.append(F.when(place >= chunk - before, own + 1))
    if after:
        homes.append(F.when((place < after) & (own > 0), own - 1))
    target = F.explode(F.array_compact(F.array(*homes))) if len(homes) > 1 else own
    copied = df.withColumn("_chunk", target)
    keep = F.col("_chunk") == F.floor(F.col(ORD) / F.lit(chunk))
    return copied, Window.partitionBy("_chunk").orderBy(ORD), keep


def with_windows(series: Series, build, lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Add columns ``build(window, once)`` that look at most ``lookback`` rows back.

    Every window expression goes through ``once(key, expression, level)``, which
    gives back a column: expressions with one key are evaluated once, however many
    features use them. An expression may use columns of lower levels.
    """
    chunk = series.chunk_rows(max(lookback, lookahead))
    copied, w, keep = haloed(series.df, chunk, lookback, lookahead)
    shared: dict[int, dict[str, Column]] = {}

    def once(key: str, e: Column, level: int = 0) -> Column:
        shared.setdefault(level, {}).setdefault(f"_w_{key}", e)
        return F.col(q(f"_w_{key}"))

    made = build(w, once)
    windowed = copied
    for level in sorted(shared):
        windowed = windowed.select("*", *[e.alias(k) for k, e in shared[level].items()])
    return windowed.where(keep).select(*[F.col(q(c)) for c in series.df.columns], *made)


@dataclass(frozen=True)
class Blocks:
    """Runs of ``rows`` rows of a chunk: any trailing window of as many rows is the beginning of
    its last row's block and the end of the block before, so no frame is read again per row."""

    rows: int
    starts: WindowSpec
    ends: WindowSpec
    older: Column           # whether the window begins in the block before


def blocks(w: WindowSpec, rows: int, once) -> Blocks:
    number = once("row", F.row_number().over(w))
    block = once(f"block|{rows}", F.floor((number - 1) / rows), 1)
    frame = Window.partitionBy("_chunk", block)
    return Blocks(rows, frame.orderBy(ORD).rowsBetween(Window.unboundedPreceding, 0),
                  frame.orderBy(F.desc(ORD)).rowsBetween(Window.unboundedPreceding, 0), number % rows != 0)


def both_sides(key: str, e: Column, part: Blocks, w: WindowSpec, once) -> tuple[Column, Column]:
    """An aggregate over the window's rows in the own block, and over those in the block before (null if none)."""
    mine = once(f"{key}|own|{part.rows}", e.over(part.starts), 2)
    end = once(f"{key}|end|{part.rows}", e.over(part.ends), 2)
    before = once(f"{key}|before|{part.rows}", F.lag(end, part.rows - 1).over(w), 3)
    return mine, F.when(part.older, before)


def _carry_in(df: DataFrame, latest: dict[str, Column], n: int, chunk: int, by: list[str]) -> DataFrame:
    """Per chunk, the last non-null value of each expression in any earlier chunk."""
    tails = df.groupBy(*by, F.floor(F.col(ORD) / F.lit(chunk)).alias("_chunk")).agg(
        *[F.max_by(e, F.when(e.isNotNull(), F.col(ORD))).alias(k) for k, e in latest.items()])
    tails = tails.withColumnRenamed("_chunk", ORD)
    chunks = math.ceil(n / chunk)
    filled = _last_seen(tails, {k: F.col(q(k)) for k in latest}, chunks, chunk, by)
    return filled.select(*by, (F.col(ORD) + 1).alias("_chunk"), *[F.col(q(k)).alias(f"_in_{k}") for k in latest])


def _last_seen(df: DataFrame, latest: dict[str, Column], n: int, chunk: int, by: list[str],
               inclusive: bool = True) -> DataFrame:
    """Replace each named column by its last non-null value at (or before) the row.

    One window per chunk plus a value carried over from earlier chunks; the
    carry table is a series of chunks and is treated the same way, so its depth
    grows with the logarithm of the series length. Chunks are dense except at
    a range's ends, where an absent chunk simply carries nothing.
    """
    tmp = df.select("*", *[e.alias(f"_v_{k}") for k, e in latest.items()])
    tmp = tmp.withColumn("_chunk", F.floor(F.col(ORD) / F.lit(chunk)))
    w = Window.partitionBy(*by, "_chunk").orderBy(ORD).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = {k: F.last(F.col(q(f"_v_{k}")), ignorenulls=True).over(w) for k in latest}
    if n > chunk:
        values = {k: F.col(q(f"_v_{k}")) for k in latest}
        carry = _carry_in(tmp.drop("_chunk"), values, n, chunk, by)
        if (n / chunk) * len(latest) <= BROADCAST_CELLS:
            carry = F.broadcast(carry)
        tmp = tmp.join(carry, [*by, "_chunk"], "left")
        local = {k: F.coalesce(e, F.col(q(f"_in_{k}"))) for k, e in local.items()}
    drop = ["_chunk", *[f"_v_{k}" for k in latest], *[f"_in_{k}" for k in latest]]
    keep = [F.col(q(c)) for c in tmp.columns if c not in latest and c not in drop]
    return tmp.select(*keep, *[e.alias(k) for k, e in local.items()])


def last_seen(series: Series, latest: dict[str, Column], inclusive: bool = True,
              by: list[str] | None = None) -> DataFrame:
    """Forward fill: columns named in ``latest`` hold the last non-null value of
    their expression at the row (``inclusive``) or strictly before it. ``by``
    keeps segments apart."""
    chunk = max(series.chunk_rows(), 2)
    filled = _last_seen(series.df, latest, series.n, chunk, by or [], inclusive)
    order = [c for c in series.df.columns if c in filled.columns]
    return filled.select(*[F.col(q(c)) for c in order],
                         *[F.col(q(c)) for c in filled.columns if c not in order])
