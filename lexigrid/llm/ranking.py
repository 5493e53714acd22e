"""One ranking from several scores of unlike scale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.skew import hot_split_join, running_total
from lexigrid.session import cut

#: Makes the median absolute deviation of normal values their standard deviation.
MAD_TO_SIGMA = 1.4826
#: The bounded value of a component that an article has no score for: that of the median.
ABSENT = 0.5
#: Values of a group up to which one summary has its exact lower median; in larger groups it is selected by counting.
SUMMARY = 10_000
#: Bits by which a median's values are counted in each step.
DIGIT = 16
#: Standard deviations that map to the logistic's unit: 1 keeps typical scores in its linear part.
SOFTNESS = 1.0
#: Stretches of the combined score that a query's places are counted in.
STRETCHES = 512


def latest_scores(scores: DataFrame) -> DataFrame:
    """(qid, article_id, component, score): of several scores the one with the latest scored_at; null and NaN say nothing.

    Null times are the oldest; of scores at the same time the greater holds. Rows without qid, article or component are left out.
    """
    ok = scores.filter("qid is not null and article_id is not null and component is not null and score is not null and not isnan(score)")
    when = F.coalesce(F.unix_micros(F.col("scored_at").cast("timestamp")), F.lit(-(2**62)))
    return ok.groupBy("qid", "article_id", "component").agg(F.max(F.struct(when.alias("at"), F.col("score").alias("score")))["score"].alias("score"))


def lower_medians(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., median, n): the exact lower median of each group: of n values the one at place (n + 1) / 2, rounded down.

    Groups of up to SUMMARY values merge summaries that keep them all. Larger groups are counted by ranges of the value, in which each step halves what
    may be the median DIGIT times, until all that is left is one value; counts are combined before the shuffle, so a group with a third of all rows is never
    in one task.
    """
    g = cut(values.groupBy(*keys).agg(F.percentile_approx(value, 0.5, SUMMARY).alias("median"), F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")))
    small = g.filter(F.col("n") <= SUMMARY).select(*keys, "median", "n")
    left = cut(g.filter(F.col("n") > SUMMARY).select(*keys, "n", "lo", "hi", ((F.col("n") + 1) / 2).cast("long").alias("place")))
    out, buckets = small, 1 << DIGIT
    while not left.isEmpty():
        # What is left of a group lies in [lo, hi]; it is counted in equal ranges of it.
        done = left.filter("lo = hi").select(*keys, F.col("lo").alias("median"), "n")
        out = out.unionByName(done)
        left = left.filter("lo < hi")
        rows = hot_split_join(values.select(*keys, value), left.withColumnRenamed("n", "_n").withColumn("n", F.col("_n")), keys, "_n").filter(F.col(value).between(F.col("lo"), F.col("hi")))
        width = F.col("hi") / buckets - F.col("lo") / buckets
        at = F.when(width > 0, F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("lo")) / width))).otherwise(F.when(F.col(value) > F.col("lo"), 1).otherwise(0)).cast("int")
        counts = rows.withColumn("_b", at).groupBy(*keys, "_b").agg(F.count("*").alias("_c"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.first("n").alias("n"), F.first("place").alias("place"))
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        here = counts.withColumn("_u", upto).filter("_u >= place and _u - _c < place")
        left = cut(here.select(*keys, "n", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("place") - F.col("_u") + F.col("_c")).alias("place")))
    return cut(out)


def bounded_scores(scores: DataFrame) -> DataFrame:
    """latest_scores with value: the score less its query's and component's lower median, in robust deviations, through the logistic curve.

    Medians are exact and the lower of two middle values, also that of the deviations. Where the median absolute deviation is 0, the mean absolute
    deviation takes its place; where that is 0 too, all scores are the same and the value is 0.5.
    """
    s = cut(latest_scores(scores))
    keys = ["qid", "component"]
    a = cut(hot_split_join(s, lower_medians(s, keys, "score"), keys, "n").withColumn("off", F.abs(F.col("score") - F.col("median"))).withColumnRenamed("median", "mid"))
    mean = a.groupBy(*keys).agg(F.avg("off").alias("aad"))
    dev = lower_medians(a, keys, "off").withColumnRenamed("median", "mad").join(mean, keys)
    b = hot_split_join(a, dev, keys, "n")
    sigma = F.when(F.col("mad") > 0, F.col("mad") * MAD_TO_SIGMA).when(F.col("aad") > 0, F.col("aad") * 1.2533)
    z = F.when(sigma.isNull(), 0.0).otherwise((F.col("score") - F.col("mid")) / sigma)
    # exp overflows to infinity beyond 709, where the value is 0 or 1 anyway; 30 keeps both ends apart from 0 and 1.
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z / SOFTNESS))
    return b.select("qid", "article_id", "component", "score", (1 / (1 + F.exp(-z))).alias("value"))


def combined_ranking(scores: DataFrame, weights: Mapping[str, float], top: int | None = None) -> DataFrame:
    """(qid, article_id, combined, components, rank): articles by the weighted geometric mean of their bounded values.

    weights has the components that count; an article without one of them has the neutral value for it. Ties are broken by the number of
    components, then article_id. top keeps the first so many of each query, a limit Spark also applies before the shuffle.
    """
    known = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    total = float(sum(weights.values()))
    v = bounded_scores(scores.filter(F.col("component").isin(*weights)))
    w = known[F.col("component")]
    rest = (total - F.sum(w)) * F.log(F.lit(ABSENT))
    one = v.groupBy("qid", "article_id").agg(
        F.round(F.exp((F.sum(w * F.log("value")) + rest) / total), 12).alias("combined"), F.count("*").cast("int").alias("components")
    )
    if top:
        order = Window.partitionBy("qid").orderBy(F.desc("combined"), F.desc("components"), "article_id")
        return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # Places are counts of what goes before, over stretches of the score: no query is sorted in one task.
    stretch = F.floor((1 - F.col("combined")) * STRETCHES)
    return running_total(one.withColumn("_one", F.lit(1)), "_one", stretch, [F.desc("combined"), F.desc("components"), F.col("article_id")], ["qid"], out="rank").drop("_one").withColumn("rank", F.col("rank").cast("int"))
