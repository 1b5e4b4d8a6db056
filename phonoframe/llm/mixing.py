"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source gets a target of words. The rates of its documents are the closest
to 1, in the relative entropy of rates bounded by ``limit``, that meet the
target. The dual of that problem has one variable per source, and its solution
tilts documents exponentially in their size x (in units of the source's mean):

    rate(x) = limit * e^(lambda x) / (limit - 1 + e^(lambda x))

Newton's method finds lambda. Documents of one source and size share a rate, so
every step sums over a histogram (source, size, count) and not over documents.
Rates become whole copies by systematic rounding along the sizes, after which
single copies close what is left between the words taken and the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonoframe.llm.common import table, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
#: Newton steps stop here at the latest, or when every source is this close to its target.
STEPS, CLOSE = 60, 1e-9
#: Decimals of lambda that rates are computed from.
LAMBDA_DIGITS = 9
#: Single copies that a source may gain or lose after rounding.
REPAIRS = 6
#: Documents of one source and size that one task ranks.
RANKED_TOGETHER = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """source_no, source, source_size, n_docs and target of each source; `sizes` has source and size.

    Sources in order of code points, null last, weigh `weights` in turn and
    share all words; no target is above `limit` times the source's size. One row
    per source stands in one task here.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_no"), F.lit(len(weights))) + 1)
    listed = totals.withColumn("source_no", number).withColumn("_w", weight).withColumn("_cap", F.lit(float(limit)) * F.col("source_size"))
    # Fill to one level per unit of weight: sources in the order in which they reach their cap.
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_before = F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - capped) / (F.sum("_w").over(everything) - weight_before)
    filled = listed.withColumn("_level", level).withColumn("_open", F.col("_cap") / F.col("_w") >= F.col("_level"))
    final = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    target = F.least(F.col("_cap"), F.col("_w") * F.coalesce(final, F.lit(float("inf"))))
    return filled.select("source_no", "source", "source_size", "n_docs", target.alias("target"))


def rate(tilt: Column, limit: float = LIMIT) -> Column:
    # The form that doesn't overflow on either side.
    down = F.exp(-F.abs(tilt))
    return F.when(tilt > 0, limit / ((limit - 1) * down + 1)).otherwise(limit * down / (limit - 1 + down))


def multipliers(histogram: DataFrame, targets: DataFrame, limit: float = LIMIT) -> DataFrame:
    """source_no and lam (null: no finite tilt, every document at the limit)."""
    reachable = F.col("target") < limit * F.col("source_size") * (1 - 1e-12)
    unit = F.col("source_size") / F.col("n_docs")
    state = targets.where(reachable & (F.col("source_size") > 0)).select(
        "source_no", "target", unit.alias("unit"), F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("off")
    )
    slim = histogram.select("source_no", "size", "n")
    for _ in range(STEPS):
        x = F.col("size") / F.col("unit")
        r = rate(F.col("lam") * x, limit)
        sums = slim.join(state, "source_no").groupBy("source_no", "target", "unit", "lam", "lo", "hi").agg(
            F.sum(F.col("n") * x * r).alias("got"), F.sum(F.col("n") * x * x * r * (1 - r / limit)).alias("slope")
        )
        gap = F.col("got") - F.col("target") / F.col("unit")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        # Outside its bracket a step is replaced by bisection, or by doubling where one side is still open.
        middle = F.when(F.col("lo").isin(float("-inf")), F.col("hi") * 2 - 1).when(F.col("hi").isin(float("inf")), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        stepped = sums.withColumn("gap", gap).withColumn("lo", lo).withColumn("hi", hi).withColumn("next", newton)
        inside = F.col("next").isNotNull() & (F.col("next") > F.col("lo")) & (F.col("next") < F.col("hi")) & (F.abs(F.col("next") - F.col("lam")) <= 4)
        state = written(
            stepped.select(
                "source_no", "target", "unit",
                F.when(F.col("gap") == 0, F.col("lam")).when(inside, F.col("next")).otherwise(middle).alias("lam"),
                "lo", "hi", (F.abs(F.col("gap")) * F.col("unit") / F.col("target")).alias("off"),
            ),
            "mixing-lambda",
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            break
    else:
        raise RuntimeError(f"no tilt meets the targets to {CLOSE} after {STEPS} steps")
    # Sums after a shuffle have no fixed order; without its last digits lambda is the same in every run.
    return state.select("source_no", F.round("lam", LAMBDA_DIGITS).alias("lam"), "unit")


def copies_by_size(histogram: DataFrame, targets: DataFrame, lambdas: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The histogram with k, the copies that the documents of a source and size get in all."""
    rates = histogram.join(targets.select("source_no", "target"), "source_no").join(lambdas, "source_no", "left").withColumn(
        "_r", F.coalesce(rate(F.col("lam") * F.col("size") / F.col("unit"), limit), F.lit(float(limit)))
    )
    along = Window.partitionBy("source_no").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.sum(F.col("n") * F.col("_r")).over(along) + 0.5)
    by_size = Window.partitionBy("source_no").orderBy("size")
    k = F.least(F.greatest(F.col("_upto") - F.coalesce(F.lag("_upto").over(by_size), F.lit(0)), F.lit(0)), limit * F.col("n"))
    out = written(rates.withColumn("_upto", upto).withColumn("k", k).select("source_no", "size", "n", "target", "k"), "mixing-copies")
    for _ in range(REPAIRS):
        left = out.groupBy("source_no").agg((F.max("target") - F.sum(F.col("k") * F.col("size"))).alias("left"))
        sign = F.when(F.col("left") > 0, 1).otherwise(-1)
        can = F.when(F.col("left") > 0, F.col("k") < limit * F.col("n")).otherwise(F.col("k") > 0) & (F.col("size") > 0)
        then = F.abs(F.abs(F.col("left")) - F.col("size"))
        better = can & (then < F.abs(F.col("left")))
        chosen = out.join(left, "source_no").where(better).groupBy("source_no").agg(F.min(F.struct(then.alias("then"), F.col("size"), sign.alias("sign"))).alias("c"))
        step = chosen.select("source_no", F.col("c.size").alias("size"), F.col("c.sign").alias("sign"))
        out = written(out.join(step, ["source_no", "size"], "left").select("source_no", "size", "n", "target", (F.col("k") + F.coalesce("sign", F.lit(0))).alias("k")), "mixing-copies")
    return out


def mixed_copies(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sizes (doc_id, source, size; a written table) with source_size, target and copies (0 to limit) of each row.

    Null sources form the last source. A document without words has size 0 and
    one copy. Ties of source and size are cut in the order of a hash of doc_id;
    rows repeated in full are interchangeable. An empty table gives no rows.
    """
    targets = written(source_targets(sizes, weights, limit), "mixing-targets")
    numbered = sizes.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("d.doc_id", "d.source", "d.size", "t.source_no", "t.source_size", "t.target")
    histogram = written(numbered.groupBy("source_no", "size").agg(F.count("*").alias("n")), "mixing-histogram")
    copies = copies_by_size(histogram, targets, multipliers(histogram, targets, limit), limit)
    key = ["source_no", "size"]
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / RANKED_TOGETHER))
    joined = numbered.join(copies.drop("target"), key).withColumn("_part", part).withColumn("_order", F.xxhash64("doc_id", F.lit("mix")))
    # A large group of one source and size is dealt by a part of its hash.
    dealt = joined.repartition(*key, "_part")
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_order", "doc_id")))
    split = copies.where(F.col("n") > RANKED_TOGETHER).select(*key)
    counts = joined.join(split, key, "left_semi").groupBy(*key, "_part").agg(F.count("*").alias("_n")) if not split.isEmpty() else None
    if counts is None:
        placed = ranked.withColumn("_before", F.lit(0))
    else:
        before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        placed = ranked.join(counts.select(*key, "_part", F.sum("_n").over(before).alias("_before")), [*key, "_part"], "left")
    extra = (F.coalesce("_before", F.lit(0)) + F.col("_rank") <= F.col("k") % F.col("n")).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.floor(F.col("k") / F.col("n")) + extra).alias("copies"))


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1, at most three times each (the contract of ``mixed_copies``)."""
    docs = table(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mixing-sizes")
    return mixed_copies(sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
