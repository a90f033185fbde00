"""Top-k, arg-max, samples and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arg_best(df: DataFrame, by: list[str], key: Column, keep: list[str], highest: bool = True) -> DataFrame:
    """The columns `keep` of each group's row with the best key. One hash aggregate, no sort; give a struct to settle ties."""
    pick = F.max_by if highest else F.min_by
    return df.groupBy(*by).agg(pick(F.struct(*keep), key).alias("__b")).select(*by, *[F.col("__b")[c].alias(c) for c in keep])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Each group's first k rows, with `rank`. Spark limits the groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def best_views(df: DataFrame, by: list[str], view: str, score: str, k: int = 3, share: float = 0.5) -> DataFrame:
    """The k best views of each group that reach a share of the best score, with weights that add up to 1."""
    ranked = top_k(df, by, [F.col(score).desc(), F.col(view)], k)
    group = Window.partitionBy(*by)
    good = ranked.where(F.col(score) > 0).withColumn("__best", F.max(score).over(group)).where(F.col(score) >= F.col("__best") * share)
    return good.withColumn("weight", F.col(score) / F.sum(score).over(group)).drop("__best")


def top_by_importance(df: DataFrame, logit: str, scales: list[str], most: int, order: list[Column], least_opacity: float = 0.02) -> DataFrame:
    """The `most` rows of largest opacity times volume, with opacity and importance; fainter rows than least_opacity never count."""
    opacity = 1 / (1 + F.exp(-F.col(logit)))
    volume = F.exp(sum((F.col(c) for c in scales[1:]), F.col(scales[0])))
    seen = df.withColumn("opacity", opacity).where(F.col("opacity") >= least_opacity).withColumn("importance", F.col("opacity") * volume)
    return seen.orderBy(F.col("importance").desc(), *order).limit(most)


def positions(n: Column, m: int) -> Column:
    """The distinct rounded positions of m evenly spaced points from 0 to n - 1."""
    if m < 2:
        return F.array(F.lit(0).cast("long"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (n - 1) / (m - 1)).cast("long")))


def systematic_sample(df: DataFrame, by: list[str], order: list[Column], m: int) -> DataFrame:
    """About m evenly spaced rows of each group, its first and last among them."""
    group = Window.partitionBy(*by)
    ranked = df.withColumns({"__i": F.row_number().over(group.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(group)})
    return ranked.where((F.col("__n") <= m) | F.array_contains(positions(F.col("__n"), m), F.col("__i").cast("long"))).drop("__i", "__n")


def hash_sample(df: DataFrame, key: list[str], most: int, seed: str) -> DataFrame:
    """Exactly `most` rows (or all) in a seeded pseudo-random order of their keys; the same rows each time."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in key]))
    return df.withColumn("__h", h).orderBy("__h", *key).limit(most).drop("__h")


def mutual_rank(pairs: DataFrame, a: str, b: str, weight: str, most: int) -> DataFrame:
    """Unordered pairs that are within the first `most` partners of either side, with the better of the two ranks."""
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"), weight).unionByName(pairs.select(F.col(b).alias("x"), F.col(a).alias("y"), weight))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.col(weight).desc(), "y")))
    low, high = F.least("x", "y").alias(a), F.greatest("x", "y").alias(b)
    return ranked.groupBy(low, high).agg(F.first(weight).alias(weight), F.min("r").alias("rank")).where(F.col("rank") <= most)


def shares_and_roles(df: DataFrame, by: list[str], size: str, key: str, main_share: float = 0.15) -> DataFrame:
    """df with position, share of the group's size and role: the largest, and all with enough of it, are main, others fragments."""
    group = Window.partitionBy(*by)
    placed = df.withColumns({"position": F.row_number().over(group.orderBy(F.col(size).desc(), key)) - 1, "share": F.col(size) / F.sum(size).over(group)})
    return placed.withColumn("role", F.when((F.col("position") == 0) | (F.col("share") >= main_share), "main").otherwise("fragment"))


def farthest_within(df: DataFrame, by: list[str], ok: Column, distance: str, key: str) -> DataFrame:
    """Each group's farthest row that qualifies; of groups without one the middle row by key."""
    group = Window.partitionBy(*by)
    n = df.withColumns({"__i": F.row_number().over(group.orderBy(key)) - 1, "__n": F.count(F.lit(1)).over(group)})
    best = F.max_by(F.col(key), F.when(ok, F.struct(F.col(distance), -F.col(key))))
    middle = F.max(F.when(F.col("__i") == F.floor(F.col("__n") / 2), F.col(key)))
    return n.groupBy(*by).agg(best.alias("__best"), middle.alias("__middle")).select(*by, F.coalesce("__best", "__middle").alias(key))
