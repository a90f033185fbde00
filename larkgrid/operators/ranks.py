"""Exact percentiles of groups of any size: no task holds the values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch brackets each percentile within MARGIN of ACCURACY parts of the ranks; only values inside are sorted. Finer sketches, one a
#: task and group, would themselves fill the task that merges them.
ACCURACY, MARGIN = 500, 4


def percentiles(df: DataFrame, by: list[str], value: Column | str, wanted: dict[str, float]) -> DataFrame:
    """The groups with their percentiles (0 to 1, interpolated) of all values that aren't null, by name: as F.percentile has them,
    whose one task a group receives all distinct values. A group that the sketch should misjudge is counted by F.percentile.
    One small row a group is broadcast, so give it groups that are few."""
    keys = [f"__g{i}" for i in range(len(by))]
    same = lambda a, b: " and ".join(f"{x} <=> {y}" for x, y in zip(a, b)) or "true"
    v = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], (F.col(value) if isinstance(value, str) else value).cast("double").alias("__v"))
    qs, names = list(wanted.values()), [f"__s{i}" for i in range(len(by))]
    ends = [min(1.0, max(0.0, q + s * MARGIN / ACCURACY)) for q in qs for s in (-1, 1)]
    sketch = v.groupBy(*keys).agg(F.percentile_approx("__v", ends, ACCURACY).alias("__e"), F.count("__v").alias("__n"))
    named = sketch.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "__e", "__n")
    low = [F.col("__e")[2 * i] if ends[2 * i] > 0 else F.lit(None) for i in range(len(qs))]
    high = [F.col("__e")[2 * i + 1] if ends[2 * i + 1] < 1 else F.lit(None) for i in range(len(qs))]
    # per percentile: the row counts as below (null), or by its value; rows above are left out
    part = [F.when(F.coalesce(F.col("__v") <= h, F.lit(True)), F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.when(F.coalesce(F.col("__v") >= l, F.lit(True)), F.col("__v")).alias("v"))) for i, (q, l, h) in enumerate(zip(qs, low, high))]
    rows = v.where("__v is not null").join(F.broadcast(named), F.expr(same(keys, names))).select(*keys, "__n", F.explode(F.array_compact(F.array(*part))).alias("p"))
    counted = rows.groupBy(*keys, "__n", "p.i", "p.q", "p.v").agg(F.count(F.lit(1)).alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first())))
    at = F.col("q") * (F.col("__n") - 1)
    value_at = lambda place: F.min(F.when((F.col("upto") > place) & F.col("v").isNotNull(), F.col("v")))
    found = upto.groupBy(*keys, "__n", "i", "q").agg(
        value_at(F.floor(at)).alias("a"), value_at(F.ceil(at)).alias("b"),
        (F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("upto"))), F.lit(0)) <= F.floor(F.first(at))).alias("ok"),
    )
    mixed = F.when(F.floor(at) == F.ceil(at), F.col("a")).otherwise((F.ceil(at) - at) * F.col("a") + (at - F.floor(at)) * F.col("b"))
    ok = F.col("ok") & F.col("a").isNotNull() & F.col("b").isNotNull()
    each = lambda i: F.max(F.when(F.col("i") == i, F.when(ok, mixed)))
    per = found.groupBy(*keys).agg(*[each(i).alias(n) for i, n in enumerate(wanted)], F.bool_and(ok).alias("__ok"))
    missed = per.where("not __ok").select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    again = v.join(missed, F.expr(same(keys, names)), "left_semi").groupBy(*keys).agg(*[F.percentile("__v", F.lit(q)).alias(n) for n, q in wanted.items()])
    empty = sketch.where("__n = 0").select(*keys, *[F.lit(None).cast("double").alias(n) for n in wanted])
    done = per.where("__ok").drop("__ok").unionByName(again).unionByName(empty)
    return done.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *wanted)
