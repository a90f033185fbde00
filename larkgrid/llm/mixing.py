"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Targets: each source wants level * weight words, at most max_epochs times its size; the level is where the targets add up to
the share of all words. Taking: a source at target / size = 1.4 gives every document once and 40 % of its words once more.
The documents of that fraction are those whose seeded hash lies below a cut, found from sums over 1024 slices of the hash and
1024 slices of the slice that the target ends in, so no source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkgrid.llm.common import all_salts, materialize, salt_of

WEIGHTS, SHARE, MAX_EPOCHS, SEED, SLICES = (3, 1, 2), 1.5, 2, "mix-1", 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """20 seeded pseudo-random bits of a document."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 5), 16, 10).cast("long")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], parts: int = 32) -> DataFrame:
    """df with the running totals of `sums` in the order given, this row included, without one task for all rows."""
    cut = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "prefix")
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over at most `parts` rows
    totals = cut.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in sums])
    return (
        cut.withColumns({f"__s_{k}": F.sum(c).over(own) for k, c in sums.items()})
        .join(F.broadcast(offsets), "__part")
        .withColumns({k: F.col(f"__s_{k}") + F.col(f"__o_{k}") for k in sums})
        .drop("__part", *[f"__{p}_{k}" for k in sums for p in "so"])
    )


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight, target from (source, size). Sources by code point, null last, take the weights in turn."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(sources, [F.col("source").isNull(), F.col("source")], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    filled = prefix_sums(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), [F.col("ratio"), F.col("rank")], {"cap_sum": F.col("cap"), "weight_sum": F.col("weight")})
    filled = materialize(filled, "sources")
    whole = filled.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    total = F.col("all_size") * F.lit(share)
    # the level if exactly the sources before this one were at their caps
    level = (total - (F.col("cap_sum") - F.col("cap"))) / (F.col("all_weight") - (F.col("weight_sum") - F.col("weight")))
    leveled = filled.join(F.broadcast(whole)).withColumn("level", level)  # whole: one row
    found = leveled.where(F.col("level") <= F.col("ratio")).agg(F.min_by("level", F.struct("ratio", "rank")).alias("found"))
    target = F.least(F.col("weight") * F.coalesce(F.col("found"), F.lit(float("inf"))), F.col("cap").cast("double"))
    return filled.join(F.broadcast(found)).select("source", "source_size", "weight", target.alias("target"))


def mix_plan(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """For each source: source_size, target, whole (repetitions of every document), cut and subcut of the fraction. sized: doc_id, source, size."""
    targets = source_targets(sized, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = materialize(targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    bits = sized.withColumn("bits", draw(F.col("doc_id"), seed)).withColumns({"slice": F.floor(F.col("bits") / SLICES), "sub": F.col("bits") % SLICES})

    def cut(sums: DataFrame, at: str, need: str) -> DataFrame:
        """The first slice that goes beyond need, and the words before it."""
        running = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)  # at most 1024 rows
        sums = sums.join(targets_of(sums, need), "__key").withColumn("upto", F.sum("words").over(running))
        return sums.where(F.col("upto") > F.col(need)).groupBy("source").agg(F.min_by(F.struct(at, (F.col("upto") - F.col("words")).alias("before"), "words"), at).alias("c"))

    def targets_of(sums: DataFrame, need: str) -> DataFrame:
        return needs[need].select(key(F.col("source")).alias("__key"), need)

    def key(source: Column) -> Column:  # joins that null takes part in
        return F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))

    needs = {"need": targets}
    by_slice = bits.groupBy("source", "slice").agg(F.sum("size").alias("words")).withColumn("__key", key(F.col("source")))
    first = materialize(cut(by_slice, "slice", "need").select("source", F.col("c.slice").alias("cut"), F.col("c.before").alias("before")), "cuts")
    rest = first.select(key(F.col("source")).alias("__key"), "cut", "before").join(targets.select(key(F.col("source")).alias("__key"), "source", "need"), "__key")
    rest = materialize(rest.select("source", "cut", (F.col("need") - F.col("before")).alias("rest")), "rests")
    needs["rest"] = rest
    inside = bits.withColumn("__key", key(F.col("source"))).withColumn("salt", salt_of("doc_id"))
    inside = inside.join(rest.select(key(F.col("source")).alias("__key"), "cut", all_salts("salt")), ["__key", "salt"]).where(F.col("slice") == F.col("cut"))
    by_sub = inside.groupBy("source", "sub").agg(F.sum("size").alias("words")).withColumn("__key", key(F.col("source")))
    # of the slice that goes beyond, the nearer side
    second = cut(by_sub, "sub", "rest").join(rest.select(key(F.col("source")).alias("__key2"), "rest"), key(F.col("source")) == F.col("__key2"))
    second = second.select("__key2", F.when(F.col("rest") - F.col("c.before") > F.col("c.words") / 2, F.col("c.sub") + 1).otherwise(F.col("c.sub")).alias("subcut"))
    plan = targets.withColumn("__key", key(F.col("source")))
    plan = plan.join(rest.select(key(F.col("source")).alias("__key"), "cut"), "__key", "left").join(second, F.col("__key") == F.col("__key2"), "left")
    return materialize(plan.select("__key", "source_size", "target", "whole", F.coalesce("cut", F.lit(SLICES)).alias("cut"), F.coalesce("subcut", F.lit(SLICES)).alias("subcut"), (F.col("need") > 0).alias("some")), "mix-plan")


def with_copies(docs: DataFrame, plan: DataFrame, seed: str = SEED, names: tuple[str, str, str] = ("source_size", "target", "copies")) -> DataFrame:
    """docs (doc_id, source, ...) with source_size, target and copies, how often the mix takes the document, under the given names;
    columns of docs of these names are replaced."""
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce(F.col("source"), F.lit("")))
    joined = docs.withColumns({"__key": key, "__salt": salt_of("doc_id"), "__bits": draw(F.col("doc_id"), seed)}).join(
        plan.select("__key", all_salts("__salt"), *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "whole", "cut", "subcut", "some")]), ["__key", "__salt"]
    )
    slice_, sub = F.floor(F.col("__bits") / SLICES), F.col("__bits") % SLICES
    more = F.col("__some") & ((slice_ < F.col("__cut")) | ((slice_ == F.col("__cut")) & (sub < F.col("__subcut"))))
    clash = [c for c in docs.columns if c.lower() in names]
    return joined.withColumns({"__copies": F.col("__whole") + more.cast("long")}).select(
        *[F.col(c) for c in docs.columns if c not in clash], F.col("__source_size").alias(names[0]), F.col("__target").alias(names[1]), F.col("__copies").alias(names[2])
    )


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix: each row of docs as often as the mix takes it, with `copy` (from 1) as a further column.

    Null text has size 0, a null source is a source of its own, rows of equal doc_id share their fate, an empty table gives an
    empty table, a source without words has target 0 and its documents are not taken. Extra columns pass through,
    but for one named copy.
    """
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    mixed = with_copies(docs, mix_plan(sized, weights, share, max_epochs, seed), seed, ("__size_of", "__aim", "__times"))
    rest = [c for c in docs.columns if c.lower() != "copy"]
    return mixed.where("__times > 0").select(*rest, F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("copy"))
