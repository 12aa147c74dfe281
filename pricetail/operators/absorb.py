"""Absorbing fixed effects: the collapsed panel and its level effects.

Rows are first collapsed to one record per combination of fixed-effect levels,
clusters and factor values, holding counts, means and within-record products.
Every later pass reads these records, which are never rewritten: a sweep only
updates one small table of effects per dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_finite
from ..session import checkpointed, discard, materialise

# Largest effect table that is broadcast; its size is known before it is used.
BROADCAST_BYTES = 64 << 20
# Beyond that size, the levels holding most records are spread over this many
# salted copies.  Their number is fixed, so the copies stay few.
SALTED_LEVELS = 1024
SALTS = 64

# Largest last movement of an effect, in standard deviations of its variable.
TOLERANCE = 1e-9
# Effects of all dimensions together that the driver may hold, levels times variables: 64 MB.
HELD_CELLS = 8 << 20
PLANNED_CELLS = 1 << 14
# Levels of all dimensions but the largest, up to which the largest is solved out of the sweeps.
FEW_LEVELS = 1024
# Levels of the last dimension, up to which the others are swept in the groups they share.
GROUPED_LEVELS = 1 << 14
# Cells of the matrix of large levels by other levels that a task holds at a time: 32 MB.
CROSSED_CELLS = 4 << 20
# Cells of groups that a task sweeps at a time.
SWEPT_CELLS = 1 << 18
# Sweeps after which groups are written with their effects, so that fewer are run again.
REPLAYED = 24
# Records of one task in a step on vectors.
ROWS_A_TASK = 100_000
# Sweeps that an extrapolation looks back on.
MEMORY = 8
# The first sweeps settle the sizes of the effects and are not extrapolated.
SETTLED = 3
# Effects are written out as tables in every third sweep, checkpointed in others.
WRITE_EVERY = 3
MAX_SWEEPS = 1000


class NotConverged(RuntimeError):
    """The effects still move after the last sweep allowed."""


@dataclass
class Effects:
    """Effects of one dimension: one row per level with a column per variable."""

    keys: list[str]
    table: DataFrame
    levels: int
    width: int
    hot: DataFrame | None = field(default=None)

    @property
    def small(self) -> bool:
        # Keys may be text; the other columns are numbers.
        row = 64 * len(self.keys) + 16 * (self.width - len(self.keys))
        return self.levels * row <= BROADCAST_BYTES


def _join_effects(records: DataFrame, effects: Effects, record_keys: list[str]) -> DataFrame:
    """Inner join of records with the effects of their level.

    A small table is broadcast.  A large one is shuffled; levels that hold many
    records are split by a salt taken from the whole record key, and their
    effects are copied once per salt.
    """
    table = effects.table.drop("_records")
    if effects.small:
        return records.join(F.broadcast(table), effects.keys)
    if effects.hot is None:
        top = effects.table.orderBy(F.desc("_records"), *effects.keys).limit(SALTED_LEVELS)
        effects.hot = materialise(top.select(*effects.keys, F.lit(True).alias("_hot")))
    hot = F.broadcast(effects.hot)
    spread = 1 + F.pmod(F.xxhash64(*record_keys), F.lit(SALTS)).cast("int")
    salted = records.join(hot, effects.keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(0)
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    copied = table.join(hot, effects.keys, "left").withColumn("_salt", F.explode(copies))
    joined = salted.drop("_hot").join(copied.drop("_hot"), [*effects.keys, "_salt"])
    return joined.drop("_salt")


def _left_over(column: str, joined: list[int]) -> str:
    """SQL text of a column minus the effects joined for it."""
    return " - ".join([f"`{column}`", *[f"`_e{i}_{column}`" for i in joined]])


def remove_effects(
    records: DataFrame, effects: list[Effects | None], columns: list[str], record_keys: list[str]
) -> tuple[DataFrame, dict[str, str]]:
    """Join the given effects; return the frame and, as SQL, what is left of each column."""
    joined = [i for i, one in enumerate(effects) if one is not None]
    for i in joined:
        one = effects[i]
        picked = [f"`{c}`" for c in [*one.keys, "_records"]]
        picked += [f"`{c}` AS `_e{i}_{c}`" for c in columns]
        named = Effects(one.keys, one.table.selectExpr(*picked), one.levels, one.width, one.hot)
        records = _join_effects(records, named, record_keys)
        one.hot = named.hot
    return records, {c: _left_over(c, joined) for c in columns}


def absorb(
    records: DataFrame,
    by: list[str],
    dims: list[list[str]],
    columns: list[str],
    record_keys: list[str],
    weight: str = "n",
    tol: float = TOLERANCE,
    max_sweeps: int = MAX_SWEEPS,
) -> list[Effects]:
    """Level effects of every column, by sweeping the dimensions in their order.

    Where all dimensions but one have few levels together, that one is solved out
    of the sweeps (:func:`_swept_without_largest`).  Where the last one has at most
    ``GROUPED_LEVELS`` levels and all others cross its columns with the same further ones, these are swept in
    their groups (:func:`_swept_in_groups`).  Other effects that all fit the
    driver are swept as vectors (:func:`_swept_vectors`), larger ones as tables; the
    limit is the same.  Each step sets a dimension's effects to the weighted mean of what the other
    dimensions leave over; every few sweeps the effects are extrapolated.  The
    sweeps start from zero and stop when no effect
    of the second and later dimensions moves by more than ``tol`` standard
    deviations of its variable; the first dimension then moves by no more than
    the sum of these.  Effects that still move after ``max_sweeps`` raise
    :class:`NotConverged`.
    """
    unit = dict.fromkeys(columns, 1.0)
    if len(dims) > 1:
        spread = records.agg(*[F.expr(f"stddev_pop(`{c}`) AS `{c}`") for c in columns]).first()
        unit = {c: float(spread[c]) if spread[c] else 1.0 for c in columns}
    keys_of = [[*by, *[c for c in dim if c not in by]] for dim in dims]
    if len(dims) > 1:
        held = _swept_without_largest(records, keys_of, columns, record_keys, weight, unit, tol, max_sweeps)
        held = held or _swept_in_groups(records, keys_of, columns, record_keys, weight, unit, tol, max_sweeps)
        held = held or _swept_vectors(records, keys_of, columns, weight, unit, tol, max_sweeps)
        if held is not None:
            return held
    found: list[Effects | None] = [None] * len(dims)
    history: list[list[DataFrame]] = [[] for _ in dims]
    for sweep in range(max_sweeps):
        moved = 0.0
        written = sweep % WRITE_EVERY == WRITE_EVERY - 1
        for d, keys in enumerate(keys_of):
            others = [None if i == d else e for i, e in enumerate(found)]
            frame, left = remove_effects(records, others, columns, record_keys)
            means = [f"sum({weight} * ({left[c]})) / sum({weight}) AS `{c}`" for c in columns]
            new = frame.groupBy(*keys).agg(F.expr("count(1) AS _records"), *map(F.expr, means))
            old = found[d]
            watch = ["count(1) AS levels"]
            if old is not None and d > 0 and sweep > 1:
                before = old.table.selectExpr(*_quoted(keys), *[f"`{c}` AS `_old_{c}`" for c in columns])
                new = new.join(F.broadcast(before) if old.small else before, keys)
                moves = [f"max(abs(`{c}` - `_old_{c}`)) / {unit[c]!r}D" for c in columns]
                watch.append(f"{'greatest(' + ', '.join(moves) + ')' if len(moves) > 1 else moves[0]} AS moved")
            seen = Observation()
            new = new.observe(seen, *map(F.expr, watch)).select(*keys, "_records", *_quoted(columns))
            new = materialise(new) if written else checkpointed(new)
            result = seen.get
            hot = old.hot if old else None
            found[d] = Effects(keys, new, result["levels"], len(keys) + len(columns) + 1, hot)
            history[d] = [*history[d][-2:], new]
            if old is not None and sweep % WRITE_EVERY == 0:
                discard(old.table)
            moved = max(moved, result.get("moved") or 0.0)
        if len(dims) == 1 or (sweep > 1 and moved < tol):
            break
        if written and sweep > WRITE_EVERY:
            _extrapolate(found, history, columns)
    else:
        raise NotConverged(f"effects still move by {moved:.1e} standard deviations after {max_sweeps} sweeps")
    return found


# --- the largest dimension solved out ------------------------------------------------------


def _swept_without_largest(
    records: DataFrame,
    keys_of: list[list[str]],
    columns: list[str],
    record_keys: list[str],
    weight: str,
    unit: dict[str, float],
    tol: float,
    max_sweeps: int,
) -> list[Effects] | None:
    """The same sweeps over the other dimensions alone, or None if these have too many levels.

    The effects of the largest dimension are means of what the others leave over,
    so a sweep needs only sums of products between the other dimensions' levels,
    within and across the large levels.  One job adds these up; the sweeps then
    run on the driver, in the dimensions' order and from zero, so that what
    dimensions share goes to the same one.  The driver receives one number a pair
    of small levels, whatever the size of the largest dimension.
    """
    spark = records.sparkSession
    estimates = records.agg(*[F.approx_count_distinct(F.xxhash64(*keys)).alias(f"d{d}") for d, keys in enumerate(keys_of)]).first()
    large = max(range(len(keys_of)), key=lambda d: estimates[d])
    others = [d for d in range(len(keys_of)) if d != large]
    room = min(FEW_LEVELS, HELD_CELLS // len(columns))
    if sum(estimates[d] for d in others) > 2 * room:
        return None
    known: dict[int, pa.Table] = {}
    for d in others:
        table = records.groupBy(*keys_of[d]).agg(F.expr("count(1) AS _records"))
        known[d] = table.limit(room + 1).toArrow()
        room -= len(known[d])
        if room < 0:
            return None
    first, count = {}, 0
    coded = records
    for d in others:
        first[d], size = count, len(known[d])
        count += size
        numbers = known[d].select(keys_of[d]).append_column(f"_c{d}", pa.array(np.arange(first[d], count, dtype="int32")))
        coded = coded.join(F.broadcast(spark.createDataFrame(numbers)), keys_of[d])
    codes, names = [f"_c{d}" for d in others], [f"_x{i}" for i in range(len(columns))]
    keys = keys_of[large]
    coded = coded.selectExpr(
        *_quoted(keys), *codes, f"CAST({weight} AS DOUBLE) AS _w", *[f"CAST(`{c}` AS DOUBLE) AS `{x}`" for c, x in zip(columns, names)], "1L AS _rows"
    )
    if not {*record_keys} <= {k for one in keys_of for k in one}:
        # Several records may have the same levels: then their number in a large level has no bound.
        means = [f"sum(_w * `{x}`) / sum(_w) AS `{x}`" for x in names]
        coded = coded.groupBy(*keys, *codes).agg(F.expr("sum(_w) AS _w"), *map(F.expr, means), F.expr("sum(_rows) AS _rows"))
    cells = F.collect_list(F.struct(*codes, "_w", *names)).alias("_cells")
    levels = materialise(coded.groupBy(*keys).agg(F.sum("_rows").alias("_records"), cells))
    effects, n_large = _swept_sums(levels, others, large, codes, names, first, count, [unit[c] for c in columns], tol, max_sweeps)
    out: dict[int, Effects] = {}
    for d in others:
        whole = known[d].select([*keys_of[d], "_records"])
        for i, c in enumerate(columns):
            whole = whole.append_column(c, pa.array(effects[first[d] : first[d] + len(known[d]), i]))
        one = spark.createDataFrame(whole)
        small = len(known[d]) * len(columns) <= PLANNED_CELLS
        out[d] = Effects(keys_of[d], one if small else materialise(one), len(known[d]), len(keys_of[d]) + len(columns) + 1)
    out[large] = Effects(keys, _large_effects(levels, keys, codes, names, columns, effects), n_large, len(keys) + len(columns) + 1)
    discard(levels)
    return [out[d] for d in range(len(keys_of))]


def _cell_arrays(batch: pa.RecordBatch, codes: list[str], names: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The large level's place in the batch, the small levels, the weight and the values of every cell."""
    lists = batch["_cells"]
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    at = [np.asarray(flat.field(c)).astype("int64") for c in codes]
    return row, at, np.asarray(flat.field("_w")), np.column_stack([np.asarray(flat.field(x)) for x in names])


def _swept_sums(
    levels: DataFrame,
    others: list[int],
    large: int,
    codes: list[str],
    names: list[str],
    first: dict[int, int],
    count: int,
    unit: list[float],
    tol: float,
    max_sweeps: int,
) -> tuple[np.ndarray, int]:
    """Effects of the small levels, one row each, and the number of large levels."""
    width, square = len(names), count * count

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within, both = np.zeros((count, count)), np.zeros(square)
        sums, left = np.zeros((count, width)), np.zeros((count, width))
        seen = 0
        for batch in batches:
            for start in range(0, len(batch), max(1, CROSSED_CELLS // count)):
                some = batch.slice(start, max(1, CROSSED_CELLS // count))
                row, at, w, x = _cell_arrays(some, codes, names)
                total = np.bincount(row, weights=w, minlength=len(some))
                mean = np.column_stack([np.bincount(row, weights=w * x[:, i], minlength=len(some)) for i in range(width)]) / total[:, None]
                crossed = np.zeros(len(some) * count)
                for k, one in enumerate(at):
                    crossed += np.bincount(row * count + one, weights=w, minlength=len(crossed))
                    for other in at[k:]:
                        both += np.bincount(one * count + other, weights=w, minlength=square)
                    for i in range(width):
                        sums[:, i] += np.bincount(one, weights=w * x[:, i], minlength=count)
                        left[:, i] += np.bincount(one, weights=w * (x[:, i] - mean[row, i]), minlength=count)
                crossed = crossed.reshape(len(some), count)
                within += (crossed / total[:, None]).T @ crossed
                seen += len(some)
        if seen:
            made = np.concatenate([np.triu(within).ravel(), both, sums.ravel(), left.ravel(), [float(seen)]])
            place = np.flatnonzero(made)
            yield pa.record_batch({"place": pa.array(place, pa.int64()), "value": pa.array(made[place])})

    found = levels.mapInArrow(task, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    made = np.zeros(2 * square + 2 * count * width + 1)
    made[np.asarray(found["place"].combine_chunks())] = np.asarray(found["value"].combine_chunks())
    within, both, sums, left = np.split(made[:-1], np.cumsum([square, square, count * width]))
    within, both = (m.reshape(count, count) for m in (within, both))
    within, both = within + np.triu(within, 1).T, both + np.triu(both, 1).T
    sums, left = sums.reshape(count, width), left.reshape(count, width)
    weights = np.diag(both).copy()
    np.fill_diagonal(both, 0.0)
    ends = {d: e for d, e in zip(others, [*[first[d] for d in others[1:]], count])}
    part = {d: slice(first[d], ends[d]) for d in others}
    effects = np.zeros((count, width))
    for d in others:
        # Dimensions before the largest have their first turn before it.
        if d < large:
            effects[part[d]] = (sums[part[d]] - both[part[d]] @ effects) / weights[part[d], None]
    order = [d for d in others if d > large] + [d for d in others if d < large]
    mixer = [Extrapolation(MEMORY) for _ in names]
    scale = np.array(unit)
    for _ in range(max_sweeps):
        start, rest = effects.copy(), left + within @ effects
        for d in order:
            effects[part[d]] = (rest[part[d]] - both[part[d]] @ effects) / weights[part[d], None]
        moved = float((np.abs(effects - start) / scale).max()) if effects.size else 0.0
        if moved < tol:
            return effects, int(made[-1])
        effects = np.column_stack([m.next(start[:, i], effects[:, i]) for i, m in enumerate(mixer)])
    raise NotConverged(f"effects still move by {moved:.1e} standard deviations after {max_sweeps} sweeps")


def _large_effects(levels: DataFrame, keys: list[str], codes: list[str], names: list[str], columns: list[str], effects: np.ndarray) -> DataFrame:
    """Means of what the small levels' effects leave over, one row a large level."""
    held = levels.sparkSession.sparkContext.broadcast(effects)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, w, x = _cell_arrays(batch, codes, names)
            left = x - sum(held.value[one] for one in at)
            total = np.bincount(row, weights=w, minlength=len(batch))
            means = [np.bincount(row, weights=w * left[:, i], minlength=len(batch)) / total for i in range(len(columns))]
            yield pa.record_batch([*[batch[k] for k in [*keys, "_records"]], *map(pa.array, means)], names=[*keys, "_records", *columns])

    fields = [levels.schema[k] for k in [*keys, "_records"]]
    return materialise(levels.mapInArrow(task, T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in columns]])))


# --- dimensions swept in the groups they share ----------------------------------------------


def _swept_in_groups(
    records: DataFrame,
    keys_of: list[list[str]],
    columns: list[str],
    record_keys: list[str],
    weight: str,
    unit: dict[str, float],
    tol: float,
    max_sweeps: int,
) -> list[Effects] | None:
    """The same sweeps with all dimensions but the last kept where their groups are, or None.

    The last dimension has at most ``GROUPED_LEVELS`` levels, and every other one must be the same
    further columns (the group, say a store) crossed with some of the last one's.
    A group's levels then meet other groups only through the last dimension, and a
    group has at most one cell a level of that.  A sweep is one job, in which tasks run
    their groups' sweeps from the last written ones on; the driver receives one sum a
    level of the last dimension and, from each task, the triangle that the weights of
    the extrapolation follow from.
    """
    few = keys_of[-1]
    shared = [k for k in keys_of[0] if k not in few]
    if not shared or any({*keys} - {*few} != {*shared} for keys in keys_of[:-1]):
        return None
    spark = records.sparkSession
    table = records.groupBy(*few).agg(F.expr("count(1) AS _records"), F.expr(f"sum({weight}) AS _weight"))
    known = table.limit(GROUPED_LEVELS + 1).toArrow()
    if not 0 < len(known) <= GROUPED_LEVELS:
        return None
    count, width, names = len(known), len(columns), [f"_x{i}" for i in range(len(columns))]
    numbers = known.select(few).append_column("_c", pa.array(np.arange(count, dtype="int32")))
    coded = records.join(F.broadcast(spark.createDataFrame(numbers)), few).selectExpr(
        *_quoted(shared), "_c", f"CAST({weight} AS DOUBLE) AS _w", *[f"CAST(`{c}` AS DOUBLE) AS `{x}`" for c, x in zip(columns, names)], "1L AS _rows"
    )
    if not {*record_keys} <= {k for one in keys_of for k in one}:
        means = [f"sum(_w * `{x}`) / sum(_w) AS `{x}`" for x in names]
        coded = coded.groupBy(*shared, "_c").agg(F.expr("sum(_w) AS _w"), *map(F.expr, means), F.expr("sum(_rows) AS _rows"))
    cells = F.collect_list(F.struct("_c", "_w", *names, "_rows")).alias("_cells")
    groups = materialise(coded.groupBy(*shared).agg(cells).withColumn("_start", F.expr("CAST(array() AS ARRAY<DOUBLE>)")))
    within = [_numbered(known, [k for k in keys if k in few]) for keys in keys_of[:-1]]
    swept = _GroupSweeps([codes for codes, _ in within], [len(t) for _, t in within], names, count, [records.schema[k] for k in few])
    weights = np.asarray(known["_weight"].combine_chunks(), dtype="float64")[:, None]
    scale = np.array([unit[c] for c in columns])
    plan: list[tuple[np.ndarray, list[np.ndarray] | None]] = [(np.zeros((count, width)), None)]
    points: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_sweeps):
        sums, triangles, moved = swept.sums(groups, plan, scale)
        start, after = plan[-1][0], sums / weights
        moved = max(moved, float((np.abs(after - start) / scale).max()))
        if moved < tol:
            break
        points = [*points[-MEMORY:], (after, after - start)]
        shares, mixed = None, after
        if len(points) >= SETTLED:
            shares = []
            for i in range(width):
                seen = np.vstack([*[t[i] for t in triangles], _moves(points, i)])
                shares.append(np.linalg.lstsq(seen[:, :-1], seen[:, -1], rcond=1e-12)[0])
            mixed = _mixed(points, shares)
        if len(plan) == REPLAYED:
            written = swept.written(groups, plan, shares)
            discard(groups)
            groups, plan, points, shares = written, [], [], None
        plan.append((mixed, shares))
    else:
        raise NotConverged(f"effects still move by {moved:.1e} standard deviations after {max_sweeps} sweeps")
    out = []
    for d, (keys, (_, levels)) in enumerate(zip(keys_of, within)):
        one = swept.effects(groups, plan, d, keys, levels, columns)
        out.append(Effects(keys, one, one.count(), len(keys) + width + 1))
    discard(groups)
    whole = known.select([*few, "_records"])
    for i, c in enumerate(columns):
        whole = whole.append_column(c, pa.array(after[:, i]))
    one = spark.createDataFrame(whole)
    small = count * width <= PLANNED_CELLS
    return [*out, Effects(few, one if small else materialise(one), count, len(few) + width + 1)]


def _numbered(known: pa.Table, keys: list[str]) -> tuple[np.ndarray, pa.Table]:
    """Number of each row's values of some columns, and these values in the order of their numbers."""
    seen: dict[tuple, int] = {}
    first = []
    codes = np.empty(len(known), dtype="int64")
    for row, values in enumerate(zip(*[known[k].to_pylist() for k in keys]) if keys else [()] * len(known)):
        if values not in seen:
            seen[values] = len(seen)
            first.append(row)
        codes[row] = seen[values]
    return codes, known.select([*keys, "_records"]).take(pa.array(first, pa.int64()))


def _moves(points: list[tuple[np.ndarray, np.ndarray]], i: int) -> np.ndarray:
    """Changes of variable ``i``'s moves from sweep to sweep and, last, its last move."""
    return np.column_stack([*[b[1][:, i] - a[1][:, i] for a, b in zip(points, points[1:])], points[-1][1][:, i]])


def _mixed(points: list[tuple[np.ndarray, np.ndarray]], shares: list[np.ndarray]) -> np.ndarray:
    """Last results carried on by the weights of :class:`Extrapolation`, one list of weights a variable."""
    out = points[-1][0].copy()
    for i, share in enumerate(shares):
        for s, (a, b) in zip(share, zip(points, points[1:])):
            out[:, i] -= s * (b[0][:, i] - a[0][:, i])
    return out


@dataclass
class _GroupSweeps:
    """Sweeps of the dimensions within groups, run in the tasks that hold the groups.

    ``codes`` give, for each dimension, the number of a last dimension's level within
    a group, ``sizes`` how many such numbers there are.
    """

    codes: list[np.ndarray]
    sizes: list[int]
    names: list[str]
    count: int
    few: list[T.StructField]

    def _slices(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = max(1, SWEPT_CELLS // self.count)
        return (batch.slice(at, rows) for at in range(0, len(batch), rows))

    def _run(self, some: pa.RecordBatch, plan: list) -> tuple[list[np.ndarray], list, tuple]:
        """Effects by dimension after the plan's sweeps, their last results and moves, and the cells."""
        row, (code,), w, x = _cell_arrays(some, ["_c"], self.names)
        width, groups = x.shape[1], len(some)
        at = [row * n + c[code] for n, c in zip(self.sizes, self.codes)]
        total = [np.maximum(np.bincount(a, weights=w, minlength=groups * n), np.finfo(float).tiny)[:, None] for a, n in zip(at, self.sizes)]
        ends = np.cumsum([0, *[groups * n for n in self.sizes[1:]]])
        held = np.zeros((ends[-1], width))
        written = np.asarray(some["_start"].flatten())
        if len(written):
            parts = np.split(written.reshape(groups, -1, width), np.cumsum(self.sizes[1:])[:-1], axis=1)
            held = np.concatenate([p.reshape(-1, width) for p in parts])
        effects = [np.zeros((groups * self.sizes[0], width)), *np.split(held, ends[1:-1])]
        points: list[tuple[np.ndarray, np.ndarray]] = []
        for last, shares in plan:
            if points:
                held = _mixed(points, shares) if shares else points[-1][0]
                effects[1:] = np.split(held, ends[1:-1])
            base = x - last[code]
            for d, n in enumerate(self.sizes):
                left = base - sum(e[a] for i, (e, a) in enumerate(zip(effects, at)) if i != d)
                effects[d] = np.column_stack([np.bincount(at[d], weights=w * left[:, i], minlength=groups * n) for i in range(width)]) / total[d]
            after = np.concatenate([np.zeros((0, width)), *effects[1:]])
            points = [*points[-MEMORY:], (after, after - held)]
        return effects, points, (row, code, w, x, at)

    def sums(self, groups: DataFrame, plan: list, scale: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], float]:
        """By level of the last dimension what the others leave over; triangles of the moves; the largest move."""
        count, width = self.count, len(self.names)
        side = min(len(plan), MEMORY + 1)
        block = width * side * side + 1

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, moved, seen = np.zeros((count, width)), 0.0, False
            triangles = [np.zeros((0, side)) for _ in range(width)]
            for batch in batches:
                for some in self._slices(batch):
                    effects, points, (_, code, w, x, at) = self._run(some, plan)
                    left = x - sum(e[a] for e, a in zip(effects, at))
                    for i in range(width):
                        sums[:, i] += np.bincount(code, weights=w * left[:, i], minlength=count)
                        triangles[i] = np.linalg.qr(np.vstack([triangles[i], _moves(points, i)]), mode="r")
                    if points[-1][1].size:
                        moved = max(moved, float((np.abs(points[-1][1]) / scale).max()))
                    seen = True
            if seen:
                full = np.zeros((width, side, side))
                for i, t in enumerate(triangles):
                    full[i, : len(t)] = t
                begin = count * width + TaskContext.get().partitionId() * block
                place = np.concatenate([np.arange(count * width), np.arange(begin, begin + block)])
                value = np.concatenate([sums.ravel(), full.ravel(), [moved]])
                yield pa.record_batch({"place": pa.array(place, pa.int64()), "value": pa.array(value)})

        parts = groups.mapInArrow(task, "place long, value double")
        found = parts.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").toArrow()
        value = np.asarray(found["value"].combine_chunks())
        tasks = value[count * width :].reshape(-1, block)
        triangles = [t[:-1].reshape(width, side, side) for t in tasks]
        return value[: count * width].reshape(count, width), triangles, float(tasks[:, -1].max())

    def written(self, groups: DataFrame, plan: list, shares: list[np.ndarray] | None) -> DataFrame:
        """The groups with the effects that the next sweep starts from."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in self._slices(batch):
                    points = self._run(some, plan)[1]
                    held = _mixed(points, shares) if shares else points[-1][0]
                    parts = np.split(held, np.cumsum([len(some) * n for n in self.sizes[1:]])[:-1])
                    start = np.concatenate([p.reshape(len(some), -1) for p in parts], axis=1) if held.size else np.zeros((len(some), 0))
                    ends = np.arange(len(some) + 1, dtype="int32") * start.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(start.ravel()))
                    yield pa.record_batch([*[some[c] for c in some.schema.names[:-1]], lists], names=some.schema.names)

        return materialise(groups.mapInArrow(task, groups.schema))

    def effects(self, groups: DataFrame, plan: list, d: int, keys: list[str], levels: pa.Table, columns: list[str]) -> DataFrame:
        """One row a level of dimension ``d`` with its effects after the plan's sweeps."""
        inside = {k: levels[k].combine_chunks() for k in keys if k in levels.column_names}

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in self._slices(batch):
                    effects, _, (_, _, _, _, at) = self._run(some, plan)
                    rows = np.asarray(some["_cells"].flatten().field("_rows"))
                    records = np.bincount(at[d], weights=rows, minlength=len(effects[d])).astype("int64")
                    there = np.flatnonzero(records)
                    group, number = pa.array(there // self.sizes[d]), pa.array(there % self.sizes[d])
                    own = [inside[k].take(number) if k in inside else some[k].take(group) for k in keys]
                    yield pa.record_batch(
                        [*own, pa.array(records[there]), *[pa.array(effects[d][there, i]) for i in range(len(columns))]], names=[*keys, "_records", *columns]
                    )

        known = {f.name: f for f in [*groups.schema.fields, *self.few]}
        fields = [known[k] for k in keys]
        fields += [T.StructField("_records", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]]
        return materialise(groups.mapInArrow(task, T.StructType(fields)))


# --- effects as vectors ------------------------------------------------------------------


def _swept_vectors(
    records: DataFrame, keys_of: list[list[str]], columns: list[str], weight: str, unit: dict[str, float], tol: float, max_sweeps: int
) -> list[Effects] | None:
    """The same sweeps with the effects as vectors on the driver, or None if they would not fit.

    Levels get numbers once.  A step is then one job: tasks take the vectors of
    the other dimensions off their records and add up what is left by level; the
    driver receives one sum a level.  Records are never moved.
    """
    spark = records.sparkSession
    known, held = [], 0
    for keys in keys_of:
        room = HELD_CELLS // len(columns) - held
        table = records.groupBy(*keys).agg(F.expr("count(1) AS _records"), F.expr(f"sum({weight}) AS _weight"))
        known.append(table.limit(room + 1).toArrow())
        held += len(known[-1])
        if held > HELD_CELLS // len(columns):
            return None
    sizes = [len(table) for table in known]
    coded = records
    for d, (keys, table) in enumerate(zip(keys_of, known)):
        numbers = table.select(keys).append_column(f"_c{d}", pa.array(np.arange(len(table), dtype="int32")))
        coded = coded.join(F.broadcast(spark.createDataFrame(numbers)), keys)
    codes = [f"_c{d}" for d in range(len(keys_of))]
    coded = coded.selectExpr(*codes, f"CAST({weight} AS DOUBLE) AS _w", *[f"CAST(`{c}` AS DOUBLE) AS `_x{i}`" for i, c in enumerate(columns)])
    # Small tables in few tasks: a step is short, and starting tasks would be most of it.
    rows = pc.sum(known[0]["_records"]).as_py() or 0
    written = materialise(coded.coalesce(max(1, rows // ROWS_A_TASK)))
    # Read in every step; what an executor loses is read again from the written table.
    coded = written.persist()
    weights = [np.asarray(table["_weight"].combine_chunks(), dtype="float64") for table in known]
    effects = [np.zeros((n, len(columns))) for n in sizes]
    scale = np.array([unit[c] for c in columns])
    mixer = [Extrapolation(MEMORY) for _ in columns]
    for sweep in range(max_sweeps):
        start = np.concatenate(effects[1:])
        for d in range(len(effects)):
            effects[d] = _level_sums(coded, effects, d, len(columns)) / weights[d][:, None]
        after = np.concatenate(effects[1:])
        moved = float((np.abs(after - start) / scale).max()) if after.size else 0.0
        if moved < tol:
            break
        mixed = np.column_stack([m.next(start[:, i], after[:, i]) for i, m in enumerate(mixer)])
        effects[1:] = np.split(mixed, np.cumsum(sizes[1:])[:-1])
    else:
        raise NotConverged(f"effects still move by {moved:.1e} standard deviations after {max_sweeps} sweeps")
    coded.unpersist()
    discard(written)
    out = []
    for keys, table, values, n in zip(keys_of, known, effects, sizes):
        whole = table.select([*keys, "_records"])
        for i, c in enumerate(columns):
            whole = whole.append_column(c, pa.array(values[:, i]))
        one = spark.createDataFrame(whole)
        # A small table travels in the plans that use it.
        small = n * len(columns) <= PLANNED_CELLS
        out.append(Effects(keys, one if small else materialise(one), n, len(keys) + len(columns) + 1))
    return out


def _level_sums(coded: DataFrame, effects: list[np.ndarray], d: int, width: int) -> np.ndarray:
    """Weighted sums by level of dimension ``d`` of what the other dimensions leave over."""
    others = coded.sparkSession.sparkContext.broadcast({i: e for i, e in enumerate(effects) if i != d})
    levels = len(effects[d])
    names = [f"_x{i}" for i in range(width)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = None, None
        for batch in batches:
            level, w = np.asarray(batch[f"_c{d}"]), np.asarray(batch["_w"])
            left = np.column_stack([np.asarray(batch[x]) for x in names])
            for i, vector in others.value.items():
                left -= vector[np.asarray(batch[f"_c{i}"])]
            if sums is None:
                sums, seen = np.zeros((levels, width)), np.zeros(levels, dtype=bool)
            for i in range(width):
                sums[:, i] += np.bincount(level, weights=w * left[:, i], minlength=levels)
            seen[level] = True
        if sums is not None:
            at = np.flatnonzero(seen)
            yield pa.record_batch({"level": pa.array(at, pa.int32()), **{x: pa.array(sums[at, i]) for i, x in enumerate(names)}})

    parts = coded.mapInArrow(task, "level int, " + ", ".join(f"{x} double" for x in names))
    found = parts.groupBy("level").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    out = np.zeros((levels, width))
    out[np.asarray(found["level"].combine_chunks())] = np.column_stack([np.asarray(found[x].combine_chunks()) for x in names])
    others.unpersist()
    return out


class Extrapolation:
    """Where a linear fixed-point iteration is heading (Anderson's mixing).

    The next point is a weighted mean of the last results, with weights that add
    up to one and make their last moves cancel as far as they can.  So constants
    that dimensions share stay where plain sweeps put them.
    """

    def __init__(self, memory: int):
        self.memory = memory
        self.points: list[tuple[np.ndarray, np.ndarray]] = []

    def next(self, start: np.ndarray, after: np.ndarray) -> np.ndarray:
        self.points = [*self.points[-self.memory :], (after, after - start)]
        if len(self.points) < SETTLED:
            return after
        results = np.column_stack([b[0] - a[0] for a, b in zip(self.points, self.points[1:])])
        moves = np.column_stack([b[1] - a[1] for a, b in zip(self.points, self.points[1:])])
        share = np.linalg.lstsq(moves, self.points[-1][1], rcond=1e-12)[0]
        return after - results @ share


def _extrapolate(found: list[Effects], history: list[list[DataFrame]], columns: list[str]) -> None:
    """Irons-Tuck step: carry the effects on along their last move.

    The step's length comes from how the moves of the last three sweeps shrink,
    over all dimensions but the first, which the next sweep sets anew.  The new
    effects are a weighted mean of the last ones with weights that add up to
    one, so constants shared by dimensions stay where sweeping puts them.
    """
    moves, num, den = [], dict.fromkeys(columns, 0.0), dict.fromkeys(columns, 0.0)
    for one, (t0, t1, t2) in zip(found[1:], history[1:]):
        for k, table in enumerate((t0, t1)):
            before = table.selectExpr(*_quoted(one.keys), *[f"`{c}` AS `_{k}_{c}`" for c in columns])
            t2 = t2.join(F.broadcast(before) if one.small else before, one.keys)
        moves.append(t2)
        last = {c: f"(`{c}` - `_1_{c}`)" for c in columns}
        turn = {c: f"(`{c}` - 2 * `_1_{c}` + `_0_{c}`)" for c in columns}
        row = t2.agg(
            *[F.expr(f"sum({last[c]} * {turn[c]}) AS `n_{c}`") for c in columns],
            *[F.expr(f"sum({turn[c]} * {turn[c]}) AS `d_{c}`") for c in columns],
        ).first()
        for c in columns:
            num[c], den[c] = num[c] + (row[f"n_{c}"] or 0.0), den[c] + (row[f"d_{c}"] or 0.0)
    step = {c: num[c] / den[c] if den[c] > 0 else 0.0 for c in columns}
    for one, table in zip(found[1:], moves):
        carried = [f"`{c}` - {step[c]!r}D * (`{c}` - `_1_{c}`) AS `{c}`" for c in columns]
        new = materialise(table.selectExpr(*_quoted(one.keys), "_records", *carried))
        discard(one.table)
        one.table = new


def _quoted(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


@dataclass
class Panel:
    """Records with all fixed effects removed from every variable."""

    table: DataFrame
    by: list[str]
    dims: list[list[str]]
    columns: list[str]
    varying: list[str]
    keys: list[str]
    effects: list[Effects]
    # Without absorbed dimensions: one row per group with the means taken off, and the variables' names.
    means: DataFrame | None = None
    centred: list[str] = field(default_factory=list)

    def product(self, a: str, b: str) -> str:
        """SQL text of the summed product of two variables over a record's rows."""
        between = f"n * `{a}` * `{b}`"
        if a in self.varying and b in self.varying:
            first, second = sorted((a, b), key=self.varying.index)
            return f"({between} + `_w_{first}__{second}`)"
        return f"({between})"


def collapse(df: DataFrame, keys: list[str], varying: list[str]) -> DataFrame:
    """One record per key: row count, means and centred sums of products.

    Rows with a missing key or a value that is not a finite number are left
    out, as they are in any regression on them.
    """
    kept = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in varying])
    for key in keys:
        kept = kept.where(F.col(key).isNotNull())
    for c in varying:
        kept = kept.where(is_finite(F.col(c)))
    pairs = [(a, b) for i, a in enumerate(varying) for b in varying[i:]]
    # Centred while they are summed: large values would lose all digits in a difference of sums.
    centred = [f"if(count(1) > 1, covar_pop(`{a}`, `{b}`) * count(1), 0.0D) AS `_w_{a}__{b}`" for a, b in pairs]
    means = [f"avg(`{c}`) AS `{c}`" for c in varying]
    return kept.groupBy(*keys).agg(F.expr("count(1) AS n"), *map(F.expr, means + centred))


def build_panel(
    df: DataFrame,
    varying: list[str],
    derived: dict[str, Column],
    derived_from: list[str],
    absorb_dims: list[list[str]],
    by: list[str],
    clusters: list[str],
    tol: float = TOLERANCE,
    max_sweeps: int = MAX_SWEEPS,
    constant: tuple[str, ...] = (),
    drop_singletons: bool = False,
) -> Panel:
    """Collapse rows, absorb the dimensions and keep the demeaned records.

    ``derived`` are variables that are constant within a record, given as
    expressions of the ``derived_from`` key columns (dummies, the intercept).
    Without dimensions to absorb all but the ``constant`` ones lose their mean.
    """
    keys: list[str] = []
    for c in [*by, *[c for dim in absorb_dims for c in dim], *clusters, *derived_from]:
        if c not in keys:
            keys.append(c)
    records = collapse(df, keys, varying)
    if drop_singletons and absorb_dims:
        from .levels import without_singletons

        records = without_singletons(materialise(records), [[*by, *[c for c in dim if c not in by]] for dim in absorb_dims])
    records = materialise(records.withColumns(derived) if derived else records)
    columns = [*varying, *derived]
    effects: list[Effects] = []
    if absorb_dims:
        effects = absorb(records, by, absorb_dims, columns, keys, tol=tol, max_sweeps=max_sweeps)
        frame, left = remove_effects(records, effects, columns, keys)
        kept = [c for c in records.columns if c not in columns]
        demeaned = [f"{left[c]} AS `{c}`" for c in columns]
        records = materialise(frame.selectExpr(*_quoted(kept), *demeaned))
        return Panel(records, by, absorb_dims, columns, varying, keys, effects)
    # The intercept is an effect with one level: its mean is taken off, so that far-off variables keep their digits.
    centred = [c for c in columns if c not in constant]
    weighted = [f"sum(n * `{c}`) / sum(n) AS `_m_{c}`" for c in centred]
    means = records.groupBy(*by).agg(F.expr("sum(n) AS _m_rows"), *map(F.expr, weighted))
    means = materialise(means)
    others = [c for c in records.columns if c not in centred]
    if by:
        records = records.join(means, by).selectExpr(*_quoted(others), *[f"`{c}` - `_m_{c}` AS `{c}`" for c in centred])
    else:
        mean = means.first()
        records = records.selectExpr(*_quoted(others), *[f"`{c}` - {mean[f'_m_{c}'] or 0.0!r}D AS `{c}`" for c in centred])
    records = materialise(records)
    return Panel(records, by, absorb_dims, columns, varying, keys, effects, means, centred)
