"""Which parameters to try next: how much likelier candidates are among the best trials than among the others.

The good trials are the best share of the completed ones (a tenth, 25 at most), all others are the bad ones. Of each parameter both have a kernel
density (Scott's bandwidth, at least a hundredth of the range, and one kernel as wide as the range, so that nothing is impossible); a candidate's gain is
the sum over the parameters of the difference of the log densities.

Only the good trials are few; the bad ones' densities are weights on a grid of values, sums that merge before they are shuffled (see
``reports.density``), and candidates read them between the two nodes they lie between. So trials and candidates may be many.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseline.sources.scratch import saved


def suggest(trials: DataFrame, candidates: DataFrame, parameters: list[str], *, share: float = 0.1, most: int = 25, cells: int = 1000) -> DataFrame:
    """candidates with ``gain``; null where a parameter is null or outside the range of the completed trials.

    trials: trial, state, value and the parameters. Trials that are not completed, or have no value or a null parameter, are passed over; of equal
    values the earlier trial is the better one. Where all trials have one value of a parameter it adds nothing. Without two completed trials gains are 0."""
    done = saved(trials.where("state = 'COMPLETE'").where(F.col("value").isNotNull()).dropna(subset=parameters).select("trial", "value", *[F.col(p).cast("double").alias(f"p{k}") for k, p in enumerate(parameters)]))
    names = [f"p{k}" for k in range(len(parameters))]
    total = done.count()
    n_good = min(most, math.ceil(share * total))
    edge = done.orderBy(F.col("value").desc(), "trial").limit(max(1, n_good)).agg(F.min(F.struct("value", (-F.col("trial")).alias("t"))).alias("e")).first()["e"]
    is_good = (F.col("value") > edge["value"]) | ((F.col("value") == edge["value"]) & (-F.col("trial") >= edge["t"])) if edge else F.lit(False)
    tall = done.select(is_good.alias("good"), *names).unpivot(["good"], names, "parameter", "v").groupBy("good", "parameter", "v").agg(F.count("*").alias("w"))
    tall = saved(tall)
    # two rows for each parameter
    range_ = tall.groupBy("parameter").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    mean = tall.groupBy("good", "parameter").agg(F.sum("w").alias("n"), (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"))
    spread = tall.join(F.broadcast(mean), ["good", "parameter"]).groupBy("good", "parameter", "n").agg(F.sqrt(F.sum(F.col("w") * (F.col("v") - F.col("mean")) ** 2) / F.greatest(F.lit(1), F.col("n") - 1)).alias("std"))
    shape = spread.join(range_, "parameter").where("hi > lo").withColumn("h", F.greatest(F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), (F.col("hi") - F.col("lo")) / 100))
    shape = shape.withColumn("cell", (F.col("hi") - F.col("lo")) / cells)
    place = lambda v: (v - F.col("lo")) / F.col("cell")
    whole = lambda at: F.abs(at - F.round(at)) < 1e-7
    low = lambda at: F.when(whole(at), F.round(at)).otherwise(F.floor(at)).cast("long")
    part = lambda at: F.when(whole(at), 0.0).otherwise(at - F.floor(at))
    at = place(F.col("v"))
    halves = F.explode(F.array(F.struct(low(at).alias("node"), (F.col("w") * (1.0 - part(at))).alias("w")), F.struct((low(at) + 1).alias("node"), (F.col("w") * part(at)).alias("w"))))
    keys = ["good", "parameter", "n", "lo", "hi", "h", "cell"]
    grid = tall.join(F.broadcast(shape.select(*keys)), ["good", "parameter"]).select(*keys, halves.alias("g")).groupBy(*keys, "g.node").agg(F.sum("g.w").alias("w")).where("w > 0")
    nodes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells).cast("long"))).alias("x")
    z = (F.col("x") - F.col("node")) * F.col("cell") / F.col("h")
    sums = grid.select("*", nodes).groupBy(*keys, "x").agg(F.sum(F.col("w") * F.exp(z * z * -0.5) / (F.col("h") * math.sqrt(2 * math.pi))).alias("s"))
    logs = F.log((F.col("s") + 1.0 / (F.col("hi") - F.col("lo"))) / (F.col("n") + 1))
    gains = sums.groupBy("parameter", "lo", "hi", "cell", "x").agg(F.sum(F.when(F.col("good"), logs).otherwise(-logs)).alias("gain"), F.count("*").alias("sides"))
    gains = gains.withColumn("gain", F.when(F.col("sides") == 2, F.col("gain")).otherwise(0.0))
    # cells + 1 numbers for each parameter
    known = {r["parameter"]: r for r in gains.groupBy("parameter", "lo", "hi", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "gain"))), lambda s: s["gain"]).alias("gain")).collect()}
    out = F.lit(0.0)
    for name, p in zip(names, parameters, strict=True):
        v = F.col(p).cast("double")
        if name in known:
            r = known[name]
            spot = (v - F.lit(r["lo"])) / F.lit(r["cell"])
            curve = F.split(F.lit(",".join(map(repr, r["gain"]))), ",").cast("array<double>")
            a, f = low(spot).cast("int"), part(spot)
            value = F.get(curve, a) * (1.0 - f) + F.coalesce(F.get(curve, a + 1), F.lit(0.0)) * f
            out = out + F.when((v >= r["lo"]) & (v <= r["hi"]), value)
        else:
            out = out + F.when(v.isNotNull(), 0.0)
    return candidates.withColumn("gain", out)
