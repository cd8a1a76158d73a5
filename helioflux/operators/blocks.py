"""Sequential work over blocks of an ordered table: global order, scans of affine steps, machines that forget.

``in_order`` range-partitions a table, so that every task holds a stretch of the one order, whatever the keys. What follows
needs no task that holds a whole stream: positions come from counts per stretch, steps max(floor, keep * state + step) compose, so
blocks are folded to one map each and replayed from their entry states, and machines that forget are run on all blocks
at once from a guessed entry, then again only where the block before ended in another state.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block.
ROWS = 2048
#: Blocks that settle grow with the table, so that it has about so many, up to so many rows.
BLOCKS, MOST_ROWS = 32, 65_536
_LOW = 2**33 - 1


def in_order(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` in one order by (by, order), with ``_part`` (stretch of the order) and ``_i`` (place in the stretch).

    Written to the shared folder, so that stretches stay what they are. Nulls come first, equal rows in any order.
    """
    return _stretches(df, order, by).drop("_at")


def _stretches(df: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The same with ``_at``, by which the files are sorted: a filter on it reads only what it needs."""
    d = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    d = cut(d)
    return d.withColumn("_part", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit(_LOW)))


def numbered(df: DataFrame, order: Sequence[str], number: str = "n") -> DataFrame:
    """``df`` with the row number from 0 in the order, without a task for all rows: counts per stretch, handed on as offsets."""
    d = in_order(df, order)
    per = d.groupBy("_part").agg(F.count("*").alias("_n"))
    base = per.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row per stretch
    return d.join(cut(base), "_part").withColumn(number, F.col("_base") + F.col("_i")).drop("_part", "_i", "_base")


# --- affine steps with a floor ------------------------------------------------------------------------------------------------
def _after(m: Column, f: Column) -> Column:
    return F.greatest(m["c"], m["p"] * f + m["z"])


def _fold(maps: Column) -> Column:
    """(p, z, c) of f -> max(c, p f + z) for all maps of an array, one after the other."""
    one = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("z"), F.lit(-math.inf).alias("c"))
    return F.aggregate(maps, one, lambda a, m: F.struct((m["p"] * a["p"]).alias("p"), (m["p"] * a["z"] + m["z"]).alias("z"), _after(m, a["c"]).alias("c")))


def _walk(maps: Column, f: Column) -> Column:
    """State before each map of an array, from ``f`` on."""
    begin = F.struct(f.alias("f"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(maps, begin, lambda a, m: F.struct(_after(m, a["f"]).alias("f"), F.concat(a["out"], F.array(a["f"])).alias("out")), lambda a: a["out"])


def affine_scan(df: DataFrame, step: Column, keep: float, floor: float | None = None, start: Column | float = 0.0, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id"), state: str = "state") -> DataFrame:
    """``df`` with ``state`` = max(floor, keep * the state before + step), in order, and ``<state>_before``.

    ``start`` is the state before a stream's first row; a column is taken from that row. Rows go to blocks of ``ROWS`` or fewer, so
    few that keep ** -rows stays far below overflow; in a block two running windows give the map from entry to state at each
    row. Maps are folded per stretch, then walked per stream (a row a stretch), then per stretch (a row a block). ``keep``
    is above 0 and at most 1. Null steps are an error; rows with a null in ``by`` are left out.
    """
    if not 0 < keep <= 1:
        raise ValueError("keep must be above 0 and at most 1")
    by = list(by)
    rows = ROWS if keep == 1 else max(1, min(ROWS, int(500 / -math.log(keep))))
    d = df.where(" and ".join(f"`{c}` is not null" for c in by)) if by else df
    null = F.raise_error(F.lit("a step of the scan is null")).cast("double")
    d = in_order(d.withColumn("_q", F.coalesce(step.cast("double"), null)).withColumn("_f", F.lit(start) if isinstance(start, float | int) else start), order, by)
    d = d.withColumn("_b", F.expr(f"_i div {rows}"))
    block, own = [*by, "_part", "_b"], Window.partitionBy(*by, "_part", "_b").orderBy("_i")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_n", F.row_number().over(own)).withColumn("_w", F.pow(F.lit(float(keep)), -F.col("_n")))
    d = d.withColumn("_u", F.sum(F.col("_q") * F.col("_w")).over(run))
    low = F.lit(-math.inf) if floor is None else F.max(F.lit(float(floor)) * F.col("_w") - F.col("_u")).over(run)
    d = d.withColumn("_c", (F.col("_u") + low) / F.col("_w")).withColumn("_z", F.col("_u") / F.col("_w"))
    maps = d.groupBy(*block).agg(F.max_by(F.struct("_z", "_c", "_w"), "_n").alias("m"), F.min_by("_f", "_n").alias("f"))
    maps = maps.select(*block, (1 / F.col("m._w")).alias("p"), F.col("m._z").alias("z"), F.col("m._c").alias("c"), "f")
    parts = maps.groupBy(*by, "_part").agg(F.sort_array(F.collect_list(F.struct("_b", "p", "z", "c"))).alias("m"), F.min_by("f", "_b").alias("f"))  # a stretch's blocks
    fold = parts.withColumn("s", F.struct(F.col("_part"), _fold(F.col("m")).alias("m"), F.col("f")))
    whole = fold.groupBy(*by).agg(F.sort_array(F.collect_list("s")).alias("s")) if by else fold.agg(F.sort_array(F.collect_list("s")).alias("s"))  # a stream's stretches
    entry = F.explode(F.arrays_zip(F.col("s._part").alias("part"), _walk(F.col("s.m"), F.get("s", F.lit(0))["f"]).alias("f0"))).alias("e")
    parts = parts.drop("f").join(whole.select(*by, entry).select(*by, F.col("e.part").alias("_part"), "e.f0"), [*by, "_part"])
    entries = parts.select(*by, "_part", F.explode(F.arrays_zip(F.col("m._b").alias("b"), _walk(F.col("m"), F.col("f0")).alias("f0"))).alias("e")).select(*by, "_part", F.col("e.b").alias("_b"), F.col("e.f0").alias("_f0"))
    d = d.drop("_f")
    d = d.join(entries, block).withColumn(state, F.greatest(F.col("_c"), F.col("_f0") / F.col("_w") + F.col("_z")))
    d = d.withColumn(f"{state}_before", F.coalesce(F.lag(state).over(own), F.col("_f0")))
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c not in (state, f"{state}_before")], state, f"{state}_before")


def ema(df: DataFrame, value: str = "value", alpha: float = 0.99, first: bool = False, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id"), state: str = "ema") -> DataFrame:
    """``df`` with the exponential mean after each row, from 0 on or, with ``first``, from the first value on."""
    return affine_scan(df, (1 - alpha) * F.col(value), alpha, None, F.col(value).cast("double") if first else 0.0, by, order, state)


def ewmv(df: DataFrame, value: str = "value", alpha: float = 0.99, by: Sequence[str] = ("stream",), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """``df`` with exponential ``mean`` and ``var`` after each row, both seeded with the first: the second scan knows the means of the first."""
    m = ema(df, value, alpha, True, by, order, "mean")
    d = F.col(value) - F.col("mean_before")
    return affine_scan(m, alpha * (1 - alpha) * d * d, alpha, None, 0.0, by, order, "var").drop("mean_before", "var_before")


# --- quantiles that merge -----------------------------------------------------------------------------------------------------
#: Rank error of a KLL sketch of this size, one-sided, at 99 %: 1.33 % of the rows, however many were merged.
KLL_SIZE, KLL_ERROR = 200, 0.0133


def quantile_track(df: DataFrame, q: float, value: str = "value", by: Sequence[str] = ("stream",), t: str = "t", width: float = 86400.0) -> DataFrame:
    """Rows (by, block, n, quantile, before): quantile ``q`` of all values up to the end of each block of time, and up to its start.

    A block's values become a sketch, combined before the shuffle; sketches, not values, are merged along the blocks. The value has a
    rank within KLL_ERROR of ``q``. Null values and times are left out; ``before`` is null in a stream's first block.
    """
    d = df.where(F.col(value).isNotNull() & F.col(t).isNotNull()).withColumn("block", F.floor(F.col(t) / width).cast("long"))
    per = d.groupBy(*by, "block").agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_SIZE)).alias("_s"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("block")  # a row per block
    d = per.withColumn("_s", F.kll_merge_agg_double("_s", F.lit(KLL_SIZE)).over(w)).withColumn("n", F.sum("_n").over(w))
    d = d.withColumn("quantile", F.kll_sketch_get_quantile_double("_s", F.lit(float(q))))
    return d.withColumn("before", F.lag("quantile").over(w)).select(*by, "block", "n", "quantile", "before")


# --- machines that keep all they have seen -----------------------------------------------------------------------------------
def sequential(df: DataFrame, make: Callable[[], object], step: Callable[[object, pd.DataFrame], list[tuple]], schema: str, by: str = "stream", order: Sequence[str] = ("t", "event_id"), close: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """One machine per stream over its rows in order: rows (by, *schema). A stream is one task's, but no task holds one.

    Rows are sorted by the shuffle, which spills, and come to Python in batches: ``step(machine, rows)`` takes the next rows of a stream
    and returns what comes of them; ``close(machine)`` what is left after the last one. Python holds a batch and a machine. Nulls come last.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    d = df.repartition(by).sortWithinPartitions(by, *[F.col(c).asc_nulls_last() for c in order])

    def out(key: object, rows: list[tuple]) -> pd.DataFrame:
        x = pd.DataFrame(rows, columns=names)
        x.insert(0, by, [key] * len(x))
        return x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for g in batches:
            if g.empty:
                continue
            k, last = g[by], g[by].shift()
            stretch = ((k != last) & ~(k.isna() & last.isna())).cumsum()
            for _, part in g.groupby(stretch.to_numpy(), sort=False):
                own = part[by].iloc[0]
                own = None if pd.isna(own) else own
                if machine is None or own != key:
                    rows = close(machine) if machine is not None and close else []
                    if rows:
                        yield out(key, rows)
                    key, machine = own, make()
                rows = step(machine, part)
                if rows:
                    yield out(key, rows)
        rows = close(machine) if machine is not None and close else []
        if rows:
            yield out(key, rows)

    return d.mapInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, {schema}")


# --- machines that forget -----------------------------------------------------------------------------------------------------
def settle(df: DataFrame, make: Callable[[], object], step: Callable[[object, dict], list[tuple]], schema: str, by: Sequence[str] = (), order: Sequence[str] = ("t",), rows: int = ROWS, rounds: int | None = None) -> DataFrame:
    """What one machine per stream gives, row by row in order, without a task that holds the stream: rows (by, *schema).

    ``step(machine, row)`` returns the rows that come of one row of ``df``. A machine's state is its ``__dict__``, of what JSON can say.
    All blocks run at once from the state of a new machine. A block whose forerunner ended in another state than it
    began with is run again from that, until none is left. The rows are those of the sequential run, for any machine; it is fast
    for one that forgets (after a reset, a pause, a zero), as then a state does not reach beyond the next block. For one that
    does not, the state is handed on from block to block: after two rounds only blocks run again whose forerunner does not, so no block
    runs for a state that is not final, and a round reads its own rows. A block has ``rows`` rows, in large tables more (see BLOCKS), which keeps the rounds few;
    in the worst case there are as many as blocks. ``rounds`` makes more than that an error.
    """
    by = list(by)
    d = _stretches(df.where(" and ".join(f"`{c}` is not null" for c in by)) if by else df, order, by)
    rows = max(rows, min(MOST_ROWS, -(-d.count() // BLOCKS)))
    d = d.withColumn("_b", F.expr(f"_i div {rows}"))
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    block = [*by, "_part", "_b"]
    fresh = json.dumps(make().__dict__)

    def ran(g: pd.DataFrame, begin: str) -> tuple[list[tuple], str]:
        m, out = make(), []
        m.__dict__.update(json.loads(begin))
        g = g.sort_values("_i")
        for i in range(0, len(g), ROWS):
            for r in g.iloc[i : i + ROWS].to_dict("records"):
                out += step(m, r)
        return out, json.dumps(m.__dict__)

    def ends(g: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = s[[*block, "_begin"]].copy()
        out["_end"] = ran(g, s["_begin"].iloc[0])[1]
        return out

    def rows_of(g: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(ran(g, s["_begin"].iloc[0])[0], columns=names, dtype=object)
        for k, c in enumerate(by):
            out.insert(k, c, g[c].iloc[0])
        return out

    def given(f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], of: DataFrame, states: DataFrame, out: str) -> DataFrame:
        """A block's rows and its state meet in its task; a state may be large, and beside every row it would take more room than all else."""
        return of.groupBy(*block).cogroup(states.select(*block, "_begin").groupBy(*block)).applyInPandas(f, out)

    kept = f"{kinds}_part long, _b long, _begin string, _end string"
    state = cut(given(ends, d, d.select(*block).distinct().withColumn("_begin", F.lit(fresh)), kept))
    before = Window.partitionBy(*by).orderBy("_part", "_b")  # a row per block
    done = 0
    first = F.shiftleft("_part", 33) + F.col("_b") * rows  # row of a block
    while True:
        due = state.withColumn("_due", F.coalesce(F.lag("_end").over(before), F.lit(fresh))).withColumn("_late", F.col("_due") != F.col("_begin"))
        if done >= 2:
            due = due.withColumn("_late", F.col("_late") & ~F.lag("_late", 1, False).over(before))
        late = cut(due.where("_late").select(*block, F.col("_due").alias("_begin")))
        lo, hi = late.agg(F.min(first), F.max(first) + rows).first()
        if lo is None:
            break
        done += 1
        if rounds is not None and done > rounds:
            raise RuntimeError(f"blocks are not settled after {rounds} rounds")
        again = given(ends, d.where((F.col("_at") >= lo) & (F.col("_at") < hi)).join(late.select(*block), block), late, kept)
        state = cut(state.join(late.select(*block), block, "left_anti").unionByName(again))
    return given(rows_of, d, state, f"{kinds}{schema}").select(*by, *names)
