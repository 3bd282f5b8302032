"""Ordered computations that survive hot keys.

A window partitioned by an entity puts all rows of that entity in one task. Here the rows are range-partitioned by entity and
order (all order columns, so that ties of the first one and text are cut too), a partition is a slice, the window runs per
(entity, slice), and what earlier slices leave behind (sums, last values, ...) is carried over from a summary with one row
per (entity, slice). Slices hold about the same number of rows, however many rows there are; an entity of ordinary size lies in one or two of them.
Small inputs are one slice, a plain window. spark.sparkloom.rowsPerSlice sets the size of a slice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from sparkloom.functions.exprs import micros
from sparkloom.session import cut_lineage

ROWS_PER_SLICE = 1_000_000
SLICE_SETTING = "spark.sparkloom.rowsPerSlice"


@dataclass(frozen=True)
class Spec:
    """One running value: kind is sum, count, min, max or last (last non-null)."""

    kind: str
    value: Column


def axis(df: DataFrame, name: str) -> Column:
    """The order column in a type that ranges are counted in, without loss: whole numbers stay whole."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("bigint")
    return F.col(name)


def _whole(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.IntegralType, T.TimestampType, T.TimestampNTZType, T.DateType))


def slice_count(df: DataFrame, rows_per_slice: int | None = None) -> int:
    """Slices of about rows_per_slice rows; their number grows with the table."""
    size = rows_per_slice or int(df.sparkSession.conf.get(SLICE_SETTING, str(ROWS_PER_SLICE)))
    return max(1, -(-df.count() // size))


def add_slice(df: DataFrame, by: list[str], slices: int, out: str = "_slice") -> DataFrame:
    """Rows with the number of their range of `by` (ascending, nulls first). The ranges are stored, so that every use of the result sees the same."""
    if slices <= 1:
        return df.withColumn(out, F.lit(0))
    ranged = df.repartitionByRange(slices, *[F.col(c).asc_nulls_first() for c in by])
    return cut_lineage(ranged.withColumn(out, F.spark_partition_id()))


def _local(spec: Spec, window) -> Column:
    if spec.kind == "sum":
        return F.sum(spec.value).over(window)
    if spec.kind == "count":
        return F.count(spec.value).over(window)
    if spec.kind == "min":
        return F.min(spec.value).over(window)
    if spec.kind == "max":
        return F.max(spec.value).over(window)
    if spec.kind == "last":
        return F.last(spec.value, ignorenulls=True).over(window)
    raise ValueError(f"unknown running value {spec.kind}")


def _total(spec: Spec, order: Column, descending: bool) -> Column:
    if spec.kind == "last":
        pick = F.min_by if descending else F.max_by
        return pick(spec.value, F.when(spec.value.isNotNull(), order))
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[spec.kind](spec.value)


def _carried(name: str, spec: Spec, window) -> Column:
    kind = "sum" if spec.kind == "count" else spec.kind
    return _local(Spec(kind, F.col(name)), window)


def _merge(kind: str, local: Column, carried: Column) -> Column:
    if kind == "count":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if kind == "sum":
        return F.coalesce(local + carried, local, carried)
    if kind == "min":
        return F.least(local, carried)
    if kind == "max":
        return F.greatest(local, carried)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, Spec],
    *,
    before: str = "through",
    descending: bool = False,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add running values per key in the given order; nulls come first, or last if descending.

    before: 'through' includes the current row, 'rows' stops at the previous row, 'range' stops
    before the current value of the first order column (all its ties are left out).
    """
    slices = slice_count(df, rows_per_slice)
    if before == "range" and (slices > 1 or not _whole(df, order[0])):
        return _before_value(df, keys, order, specs, descending, rows_per_slice)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    sliced = add_slice(df, [*keys, *order], slices)
    base = W.partitionBy(*keys, "_slice")
    if before == "range":
        at = axis(df, order[0])
        window = base.orderBy(at.desc() if descending else at.asc()).rangeBetween(W.unboundedPreceding, -1)
    else:
        window = base.orderBy(*[direction(c) for c in order]).rowsBetween(W.unboundedPreceding, 0 if before == "through" else -1)
    values = {n: _local(s, window) for n, s in specs.items()}
    if before == "range":
        # a range frame of a null holds the other nulls; what comes before a null is nothing, or all that is not null
        null, others = F.col(order[0]).isNull(), W.partitionBy(*keys, "_slice")
        for n, s in specs.items():
            nothing = F.lit(0 if s.kind == "count" else None)
            rest = _total(Spec(s.kind, F.when(~null, s.value)), F.col(order[0]), True).over(others) if descending else nothing
            values[n] = F.when(null, rest).otherwise(values[n])
    out = sliced.select("*", *[v.alias(n) for n, v in values.items()])
    if slices <= 1:
        return out.drop("_slice")

    sort_key = F.struct(*[F.col(c) for c in order])
    totals = sliced.groupBy(*keys, "_slice").agg(
        *[_total(s, sort_key, descending).alias(f"_t_{n}") for n, s in specs.items()]
    )
    step = W.partitionBy(*keys).orderBy(F.col("_slice").desc() if descending else F.col("_slice"))
    step = step.rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        *[_carried(f"_t_{n}", s, step).alias(f"_c_{n}") for n, s in specs.items()],
    )
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = out.join(carry, same, "left")
    kept = [c for c in df.columns if c not in specs]
    return joined.select(
        *kept, *[_merge(s.kind, F.col(n), F.col(f"_c_{n}")).alias(n) for n, s in specs.items()]
    )


def _before_value(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, Spec], descending: bool, rows_per_slice: int | None) -> DataFrame:
    """Values before the current value of order[0]: totals per value, then a running value over the different ones.

    Ties are one row, so a value that many rows share is summed before it is shuffled.
    """
    at = order[0]
    sort_key = F.struct(*[F.col(c) for c in order])
    totals = df.groupBy(*keys, at).agg(*[_total(s, sort_key, descending).alias(f"_t_{n}") for n, s in specs.items()])
    carried = {f"_c_{n}": Spec("sum" if s.kind == "count" else s.kind, F.col(f"_t_{n}")) for n, s in specs.items()}
    steps = running(totals, keys, [at], carried, before="rows", descending=descending, rows_per_slice=rows_per_slice)
    steps = steps.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, at]], *carried)
    same = F.col(at).eqNullSafe(F.col(f"_k_{at}"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    filled = {n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) if s.kind == "count" else F.col(f"_c_{n}") for n, s in specs.items()}
    return df.join(steps, same, "left").select(*[c for c in df.columns if c not in specs], *[e.alias(n) for n, e in filled.items()])


def previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], **kw) -> DataFrame:
    """Values of the previous row of the key: {output: column}; null on the first row."""
    packed = {f"_p_{o}": Spec("last", F.struct(F.col(c).alias("v"))) for o, c in columns.items()}
    out = running(df, keys, order, packed, before="rows", **kw)
    return out.select(
        *[c for c in df.columns if c not in columns],
        *[F.col(f"_p_{o}.v").alias(o) for o in columns],
    )


def following(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], **kw) -> DataFrame:
    return previous(df, keys, order, columns, descending=True, **kw)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "rn", **kw) -> DataFrame:
    return running(df, keys, order, {out: Spec("count", F.lit(1))}, **kw)


def tiles(df: DataFrame, order: list[str], k: int, out: str, descending: bool = False, **kw) -> DataFrame:
    """NTILE over the whole table without a single-partition window."""
    total = df.count()
    numbered = row_numbers(df, [], order, "_rn", descending=descending, **kw)
    return numbered.withColumn(out, tile_of(F.col("_rn"), total, k)).drop("_rn")


def tile_of(rn: Column, total: int, k: int) -> Column:
    small, large = total // k, total % k
    edge = large * (small + 1)
    head = F.ceil(rn / (small + 1))
    tail = large + F.ceil((rn - edge) / max(small, 1))
    return F.when(rn <= edge, head).otherwise(tail).cast("int")


def sliding(
    df: DataFrame,
    keys: list[str],
    ts: str,
    widths: dict[str, int],
    values: dict[str, Column],
    **kw,
) -> DataFrame:
    """Sums over [t - width, t) per key, current and later rows left out.

    widths: {suffix: microseconds}; values: {prefix: value column, null = not counted}. Adds
    <prefix>_<suffix>. Every row enters the running sum at its own time and leaves it one width
    later, so the cost is linear in rows x widths and does not depend on the rows in a frame.
    """
    names = list(values)
    at = micros(ts)
    base = df.select("*", *[values[n].cast("double").alias(f"_v_{n}") for n in names], at.alias("_at"))
    moves = [F.struct(F.lit(True).alias("own"), F.col("_at").alias("at"), *[
        F.col(f"_v_{n}").alias(f"d_{n}_{s}") for s in widths for n in names])]
    for suffix, width in widths.items():
        moves.append(F.struct(F.lit(False).alias("own"), (F.col("_at") + F.lit(width)).alias("at"), *[
            (-F.col(f"_v_{n}") if s == suffix else F.lit(None).cast("double")).alias(f"d_{n}_{s}")
            for s in widths for n in names]))
    drop = [f"_v_{n}" for n in names] + ["_at", "_m"]
    long = base.withColumn("_m", F.explode(F.array(*moves)))
    payload = [c for c in df.columns]
    long = long.select(
        *payload, F.col("_m.own").alias("_own"), F.col("_m.at").alias("_when"),
        *[F.col(f"_m.d_{n}_{s}").alias(f"_d_{n}_{s}") for s in widths for n in names],
    ).drop(*drop)
    specs = {f"{n}_{s}": Spec("sum", F.col(f"_d_{n}_{s}")) for s in widths for n in names}
    out = running(long, keys, ["_when"], specs, before="range", **kw)
    return out.where("_own").select(*payload, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in specs])


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
    columns: list[str], *, inclusive: bool = True, **kw,
) -> DataFrame:
    """Latest right row at or before each left row, by union and running last."""
    side_left, side_right = (1, 0) if inclusive else (0, 1)
    lcols = left.columns
    a = left.select(*[F.col(k) for k in keys], F.col(left_ts).alias("_ts"), F.lit(side_left).alias("_side"),
                    F.struct(*lcols).alias("_left"), F.lit(None).cast(_struct_of(right, columns)).alias("_right"))
    b = right.select(*[F.col(k) for k in keys], F.col(right_ts).alias("_ts"), F.lit(side_right).alias("_side"),
                     F.lit(None).cast(_struct_of(left, lcols)).alias("_left"), F.struct(*columns).alias("_right"))
    both = a.unionByName(b)
    out = running(both, keys, ["_ts", "_side"], {"_match": Spec("last", F.col("_right"))}, **kw)
    return out.where(F.col("_left").isNotNull()).select(
        *[F.col(f"_left.{c}").alias(c) for c in lcols], *[F.col(f"_match.{c}").alias(c) for c in columns]
    )


def _struct_of(df: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str, **kw) -> DataFrame:
    """Number runs of rows: a new run begins where `starts` holds."""
    flagged = df.withColumn("_start", F.when(starts, 1).otherwise(0))
    return running(flagged, keys, order, {out: Spec("sum", F.col("_start"))}, **kw).drop("_start")


def cumulative(
    df: DataFrame, value: str, weights: list[str], by: list[str] | None = None,
    descending: bool = False, strict: bool = False, **kw,
) -> DataFrame:
    """Cumulative weights over distinct values (already grouped, so ties are one row)."""
    specs = {f"cum_{w}": Spec("sum", F.col(w)) for w in weights}
    return running(df, by or [], [value], specs, descending=descending,
                   before="rows" if strict else "through", **kw)


__all__ = ["Spec", "running", "previous", "following", "row_numbers", "tiles", "tile_of", "sliding", "asof",
           "islands", "cumulative", "slice_count", "add_slice", "axis"]
