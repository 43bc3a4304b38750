"""Order statistics and order-dependent folds over any number of rows, by blocks of bounded size.

``quantiles``: exact order statistics of all groups at once, by rounds of radix histograms. ``running_medians``: the median of all earlier
values at every place of a sequence. ``first_stop``: a fold whose state is forgotten at each improvement, as a composition of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseline.sources.scratch import saved

#: Bits of a value that a round tells apart, and the most distinct values of a bucket that are looked at one by one.
DIGIT, SMALL = 16, 65_536
#: At most so many blocks of values and of places for each step; rows of a block of the fold.
BLOCKS, FOLD_ROWS = 512, 16_384


# --- exact quantiles -------------------------------------------------------------------------------------------------


def ordered_bits(value: Column) -> Column:
    """Doubles as whole numbers in the same order (the two zeros are one)."""

    def run(x: pd.Series) -> pd.Series:
        bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
        return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))

    return F.pandas_udf(run, "long")(value.cast("double"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each name in shares, the value at that share of a group's values, between neighbours in proportion; n, how many there are.

    Values are counted once each (partial sums by value). The bits of a value are taken ``DIGIT`` at a time, highest first: a round counts by
    digit in all buckets that hold a wanted rank, and keeps of each that digit's bucket. As soon as the wanted buckets have at most ``SMALL`` distinct values
    they are gone through in order. No state is larger than 2^DIGIT counts or SMALL values for a group and rank; a value's repeats are one row.

    Nulls and NaN are no values; groups without any are left out. No keys make one group (without values: no row)."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], (x + 0.0).alias("x"))
    names = [f"k{i}" for i in range(len(keys))]
    bits = saved(rows.groupBy(*names, "x").agg(F.count("*").alias("c")).withColumn("bits", ordered_bits(F.col("x"))))
    sizes = bits.groupBy(*names).agg(F.sum("c").alias("n")).where("n > 0")
    sides = [(name, side, share) for name, share in shares.items() for side in ("low", "high")]
    rank = lambda side, share: (F.floor if side == "low" else F.ceil)((F.col("n") - 1) * share).cast("long")
    wanted = F.explode(F.array(*[F.struct(rank(side, share).alias("rank")) for _, side, share in sides]))
    wanted = sizes.select(*names, wanted.alias("w")).select(*names, F.lit(0).cast("long").alias("bucket"), F.col("w.rank").alias("rank"), F.lit(0).cast("long").alias("below")).distinct()
    same = lambda a, b, more: [a[k].eqNullSafe(b[k]) for k in names] + [a[m] == b[m] for m in more]
    # bucket: the bits that are settled; below: how many values lie before the bucket
    for level in range(64 // DIGIT):
        left = 64 - DIGIT * level
        bucket = lambda shift: F.shiftright("bits", shift) if shift < 64 else F.lit(0).cast("long")
        wanted = saved(wanted)
        inside = bits.withColumn("bucket", bucket(left))
        if level:
            heads = wanted.select(*names, "bucket").distinct()
            inside = inside.join(heads, same(inside, heads, ["bucket"]), "left_semi")
        largest = inside.groupBy(*names, "bucket").count().agg(F.max("count")).first()[0] or 0
        shift = 0 if largest <= SMALL else left - DIGIT
        parts = inside.groupBy(*names, "bucket", F.shiftright("bits", shift).alias("digit")).agg(F.sum("c").alias("c"))
        before = F.sum("c").over(Window.partitionBy(*names, "bucket").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
        at = (F.col("w.rank") >= F.col("w.below") + F.col("p.before")) & (F.col("w.rank") < F.col("w.below") + F.col("p.before") + F.col("p.c"))
        p, w = parts.alias("p"), wanted.alias("w")
        found = p.join(w, [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in names] + [F.col("p.bucket") == F.col("w.bucket"), at])
        wanted = found.select(*[F.col(f"p.{k}").alias(k) for k in names], F.col("p.digit").alias("bucket"), F.col("w.rank").alias("rank"), (F.col("w.below") + F.col("p.before")).alias("below"))
        if not shift:
            break
    w, v = wanted.alias("w"), bits.alias("v")
    values = w.join(v, [F.col(f"w.{k}").eqNullSafe(F.col(f"v.{k}")) for k in names] + [F.col("w.bucket") == F.col("v.bits")]).select(*[F.col(f"w.{k}").alias(k) for k in names], "rank", "x")
    ranks = values.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    s, r = sizes.alias("s"), ranks.alias("r")
    both = s.join(r, [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in names] or F.lit(True))  # without keys: one row each

    def of(share: float) -> Column:
        place = (F.col("n") - 1) * share
        low, high = (F.col("at")[side(place).cast("long")] for side in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return both.select(*[F.col(f"s.{k}").alias(c) for k, c in zip(names, keys, strict=True)], *[of(share).alias(name) for name, share in shares.items()], "n")


# --- running medians -------------------------------------------------------------------------------------------------


def _cuts(values: DataFrame, column: str, most: int) -> DataFrame:
    """For each step at most ``most`` values, about evenly far apart in rank."""
    shares = F.array(*[F.lit((k + 1) / (most + 1)) for k in range(most)])
    return values.groupBy("step").agg(F.array_sort(F.array_distinct(F.percentile_approx(column, shares, F.lit(20 * most)))).alias("cuts"))


def block_of(cuts: Column, value: Column) -> Column:
    """Twice the number of cuts below the value, and one more if it is a cut itself."""

    def run(cuts: pd.Series, value: pd.Series) -> pd.Series:
        out, known = np.zeros(len(value), np.int64), {}
        x = value.to_numpy()
        for k, c in enumerate(cuts):
            key = c.tobytes()
            known.setdefault(key, (c, []))[1].append(k)
        for c, at in known.values():
            low = np.searchsorted(c, x[at], side="left")
            out[at] = 2 * low + (np.append(c, np.nan)[low] == x[at])
        return pd.Series(out)

    return F.pandas_udf(run, "long")(cuts, value)


def medians_of(trials: list, counts: np.ndarray, values: np.ndarray, asked: list, held: np.ndarray, held_counts: np.ndarray, n: int, below: int) -> dict:
    """Of each asked trial the number of earlier values and their median. held: values (with counts) that are earlier than all trials here, of
    n that there are in all, ``below`` of which are smaller than any that are held or asked for.

    All values stand in one linked list; from the last trial backwards its values are taken out, and the median's place moves on by no
    more than was taken out."""
    nodes, place = np.unique(np.concatenate([held, values]), return_inverse=True)
    weight = np.bincount(place, np.concatenate([held_counts, counts]), len(nodes)).astype(np.int64).tolist()
    own = place[len(held) :].tolist()
    total = n + int(counts.sum())
    after, before = list(range(1, len(nodes) + 1)), list(range(-1, len(nodes) - 1))
    order = np.argsort(np.array(trials), kind="stable")[::-1].tolist() if len(trials) else []
    nodes, out = nodes.tolist(), {}
    at, smaller, k = 0, below, 0  # the node the median is sought from, and how many values lie before it
    counts = counts.tolist()
    for trial in sorted(asked, reverse=True):
        while k < len(order) and trials[order[k]] >= trial:
            d, c = own[order[k]], counts[order[k]]
            weight[d] -= c
            total -= c
            if d < at:
                smaller -= c
            if not weight[d]:
                b, a = before[d], after[d]
                if b >= 0:
                    after[b] = a
                if a < len(nodes):
                    before[a] = b
                if d == at and (a < len(nodes) or b >= 0):
                    if a < len(nodes):
                        at = a
                    else:
                        at = b
                        smaller -= weight[b]
            k += 1
        if total > below and nodes:
            want = (total - 1) // 2
            while smaller > want and before[at] >= 0:
                at = before[at]
                smaller -= weight[at]
            while smaller + weight[at] <= want and after[at] < len(nodes):
                smaller += weight[at]
                at = after[at]
            high = nodes[at] if total // 2 < smaller + weight[at] or after[at] >= len(nodes) else nodes[after[at]]
            out[trial] = (total, (nodes[at] + high) / 2)
    return out


def running_medians(rows: DataFrame, startup: int) -> DataFrame:
    """(step, trial, n, median) for each distinct step and trial of rows (step, trial, value): how many values earlier trials have at that step, and
    their median, where there are ``startup`` or more. Rows whose value is null ask only.

    A table of ranks on two levels: for each step at most 2 * ``BLOCKS`` + 1 blocks of values (those between cuts, and cuts themselves, so
    that a frequent value is a block of its own) and as many blocks of trials, with the values in each. Its sums tell, for a block of
    trials, which blocks of values can hold a median of any of its trials: the ranks of a median move by no more than the block has values.
    Only those values (added up, so repeats are one row) go to the block, where medians are exact. A task holds one block of trials: a
    1 / BLOCKS share of a step, and about as many earlier values."""
    rows = saved(rows.where("step IS NOT NULL AND trial IS NOT NULL").groupBy("step", "trial", "value").agg(F.count("*").alias("c")))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    per_step = rows.groupBy("step").agg(F.count("*").alias("rows"))
    blocks = F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.floor(F.sqrt("rows") / 8))).cast("int")
    most = per_step.agg(F.max(blocks)).first()[0]
    if most is None:
        return rows.select("step", "trial", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("median")).limit(0)
    by_trial = _cuts(rows, "trial", most).withColumnRenamed("cuts", "trial_cuts")
    by_value = _cuts(rows.where("value IS NOT NULL"), "value", most).withColumnRenamed("cuts", "value_cuts")
    # two short arrays for each step
    cuts = by_trial.join(by_value, "step", "left").select("step", F.transform("trial_cuts", lambda x: x.cast("double")).alias("trial_cuts"), F.coalesce("value_cuts", F.array().cast("array<double>")).alias("value_cuts"))
    placed = rows.join(cuts, "step").select("step", "trial", "value", "c", block_of(F.col("trial_cuts"), F.col("trial").cast("double")).alias("tb"), F.when(F.col("value").isNotNull(), block_of(F.col("value_cuts"), F.coalesce("value", F.lit(0.0)))).alias("vb"))
    placed = saved(placed)
    table = placed.groupBy("step", "tb", "vb").agg(F.sum(F.when(F.col("vb").isNotNull(), F.col("c")).otherwise(0)).alias("c"))

    def reach(group: pa.Table) -> pa.Table:
        """For each block of trials how many earlier values there are, and how many below those that are sent; a row for each cell that is sent
        to a later block of trials, because a median of that may lie in its block of values."""
        tb, vb, c = (group.column(k).fill_null(-1).to_numpy() for k in ("tb", "vb", "c"))
        trials, of_trial = np.unique(tb, return_inverse=True)
        kinds = np.unique(vb[vb >= 0])
        counts = np.zeros((len(trials), max(1, len(kinds))), np.int64)
        some = vb >= 0
        np.add.at(counts, (of_trial[some], np.searchsorted(kinds, vb[some])), c[some])
        earlier = np.cumsum(counts, 0) - counts
        n, own = earlier.sum(1), counts.sum(1)
        upto = np.cumsum(earlier, 1)
        low, high = np.maximum(0, (n - 1 - own) // 2), np.minimum(n - 1, (n + own) // 2)
        first = (upto <= low[:, None]).sum(1)
        last = (upto <= high[:, None]).sum(1)
        below = np.where(first > 0, np.take_along_axis(upto, np.maximum(first - 1, 0)[:, None], 1)[:, 0], 0)
        sent = [(np.full(len(t), k), t, first[k] + v) for k in range(len(trials)) if n[k] for t, v in [np.nonzero(counts[:k, first[k] : last[k] + 1])]]
        to, tb0, vb0 = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*sent, strict=True) if sent else ((), (), ())))
        step = group.column("step").combine_chunks()
        more = len(to)
        return pa.table({
            "step": step.take(pa.array(np.zeros(len(trials) + more, np.int64))), "tb": np.concatenate([trials, trials[to]]), "n": np.append(n, np.zeros(more, np.int64)), "below": np.append(np.where(n > 0, below, 0), np.zeros(more, np.int64)),
            "tb0": pa.concat_arrays([pa.nulls(len(trials), pa.int64()), pa.array(trials[tb0])]), "vb0": pa.concat_arrays([pa.nulls(len(trials), pa.int64()), pa.array(kinds[vb0], pa.int64())]),
        })

    found = saved(table.groupBy("step").applyInArrow(reach, f"step {types['step']}, tb long, n long, below long, tb0 long, vb0 long"))
    heads = found.where("tb0 IS NULL").select("step", "tb", "n", "below")
    # keys of step, block and block, so that none is hot, and a frequent value is one row in each
    wants = found.where("tb0 IS NOT NULL").select(F.col("step").alias("step_"), "tb0", "vb0", F.col("tb").alias("to_tb"))
    cells = placed.where("vb IS NOT NULL").groupBy("step", "tb", "vb", "value").agg(F.sum("c").alias("c"))
    sent = cells.join(wants, (F.col("step") == F.col("step_")) & (F.col("tb") == F.col("tb0")) & (F.col("vb") == F.col("vb0"))).groupBy("step", F.col("to_tb").alias("tb"), "value").agg(F.sum("c").alias("c"))
    every = placed.select("step", "tb", F.col("trial"), "value", "c").unionByName(sent.select("step", "tb", F.lit(None).cast(types["trial"]).alias("trial"), "value", "c"))
    every = every.select(F.col("step").alias("s"), F.col("tb").alias("b"), "trial", "value", "c")

    def block(group: pa.Table, head: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], head.schema.field("step").type), pa.array([], group.schema.field("trial").type), pa.array([], pa.int64()), pa.array([], pa.float64())], ["step", "trial", "n", "median"])
        if not len(head):
            return empty
        trial, value = group.column("trial").combine_chunks(), group.column("value").combine_chunks()
        c = group.column("c").to_numpy()
        own, valued = (np.asarray(x.is_valid().to_numpy(zero_copy_only=False), bool) for x in (trial, value))
        v = value.fill_null(0.0).to_numpy().astype(np.float64)
        mine = np.flatnonzero(own & valued)
        found = medians_of(trial.take(pa.array(mine)).to_pylist(), c[mine], v[mine], list(set(trial.filter(pa.array(own)).to_pylist())), v[~own], c[~own], head.column("n")[0].as_py(), head.column("below")[0].as_py())
        found = [(t, *x) for t, x in found.items() if x[0] >= startup]
        step = head.column("step").combine_chunks().take(pa.array([0] * len(found), pa.int64()))
        return pa.table([step, pa.array([x[0] for x in found], trial.type), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64())], ["step", "trial", "n", "median"])

    return every.groupBy("s", "b").cogroup(heads.groupBy("step", "tb")).applyInArrow(block, f"step {types['step']}, trial {types['trial']}, n long, median double")


# --- a fold that forgets ---------------------------------------------------------------------------------------------

_STEPS = "block long, entry long, next long, stop string, best double, has_best boolean"


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``i``, their place from 1 in the order of some columns: sorted in ranges, numbered in each, and moved on by the ranges' sizes.
    Rows that are equal in all of them are told apart by where they are read, so that a frequent one is not one range."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = saved(rows.withColumn("_place", F.monotonically_increasing_id()))
    ranges = spread.repartitionByRange(n, *order, "_place").sortWithinPartitions(*order, "_place")
    ranges = saved(ranges.drop("_place").select("*", F.monotonically_increasing_id().alias("_i")))
    part, at = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in ranges.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    starts, total = [], 1
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(total)]
        total += sizes[p]
    start = F.create_map(*starts)[part] if starts else F.lit(1)
    return ranges.withColumn("i", (start + at).cast("long")).drop("_i")


def _follow(block: int, i: np.ndarray, complete: np.ndarray, value: np.ndarray, known: np.ndarray, trial: list, patience: int, delta: float, size: int, end: int) -> list[tuple]:
    """Where the fold goes on from each place of a block at which it may have improved: (block, entry, next, stop, best, has_best)."""
    done = np.concatenate([[0], np.cumsum(complete)])
    first, out, memo = int(i[0]), [], {}
    done_at = np.flatnonzero(complete)
    for e in range(min(size, len(i)) - 1, -1, -1):
        if not complete[e]:
            continue
        # the fold stops at the row that makes ``patience`` completed ones or twice as many in all since e, unless it improves first
        nth = done[e + 1] + patience - 1
        stop = min(int(done_at[nth]) if nth < len(done_at) else 1 << 62, e + 2 * patience)
        upto = min(stop, len(i) - 1)
        rows = np.arange(e + 1, upto + 1)
        better = complete[e + 1 : upto + 1] & ((value[e + 1 : upto + 1] > value[e] + delta) & known[e + 1 : upto + 1] if known[e] else True)
        j = int(rows[better.argmax()]) if better.any() else None
        best = (float(value[e]), True) if known[e] else (0.0, False)
        if j is not None:
            memo[e] = memo[j] if j < size and j in memo else (first + j, None, 0.0, False)
        elif stop < len(i):
            memo[e] = (None, str(trial[stop]), *best)
        else:
            memo[e] = (None, None, *best)  # the rows end
    entries = range(min(2 * patience + 1, size, len(i))) if block else [0]
    for e in entries:
        if e in memo:
            out.append((block, first + e, *memo[e]))
    return out


def first_stop(trials: DataFrame, patience: int, delta: float, block_rows: int = FOLD_ROWS) -> tuple[str | None, float | None]:
    """Where the fold over trials (trial, complete, value) stops, and the best value then. A completed trial improves if there is no best yet or its
    value is over the best by more than delta; ``patience`` completed trials or twice as many in all without improvement stop it.

    All that is carried over an improvement is its place and value, so from every place the fold's way to the next improvement (or to the stop) is
    known from the next 2 * patience rows. A block of rows, with so many more after it, tells where the fold leaves it from each place it
    can be entered at (the first 2 * patience ones); blocks are then composed in groups of 64, these again, and so on."""
    if patience < 1:
        raise ValueError("patience must be 1 or more")
    rows = numbered(trials.select("trial", F.col("complete").cast("boolean").alias("complete"), F.col("value").cast("double").alias("value")).where("trial IS NOT NULL").withColumn("later", ~F.col("complete")), ["trial", "later", "value"])
    kind = trials.schema["trial"].dataType.simpleString()
    start = trials.sparkSession.createDataFrame([(True, None, 0)], "complete boolean, value double, i long").select(F.lit(None).cast(kind).alias("trial"), "complete", "value", "i")
    rows = saved(rows.select("trial", "complete", "value", "i").unionByName(start))
    size = max(block_rows, 2 * patience + 1)
    total = rows.count()
    both = F.array(F.floor(F.col("i") / size), F.when((F.col("i") % size <= 2 * patience) & (F.col("i") >= size), F.floor(F.col("i") / size) - 1))
    spread = rows.withColumn("block", F.explode(F.array_compact(both)))

    def follow(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        v = group.column("value").combine_chunks()
        found = _follow(group.column("block")[0].as_py(), group.column("i").to_numpy(), group.column("complete").to_numpy(zero_copy_only=False).astype(bool), np.nan_to_num(v.fill_null(0.0).to_numpy().astype(np.float64), nan=np.inf, posinf=np.inf, neginf=-np.inf), np.asarray(v.is_valid().to_numpy(zero_copy_only=False), bool), group.column("trial").to_pylist(), patience, delta, size, total)
        return _table(found)

    def compose(group: pa.Table) -> pa.Table:
        rows = {(b, e): r for b, e, *r in zip(*(group.column(c).to_pylist() for c in ("block", "entry", "next", "stop", "best", "has_best")), strict=True)}
        by_entry = {e: r for (_, e), r in rows.items()}
        first = min(b for b, _ in rows)
        out = []
        for (b, e), r in rows.items():
            if b == first:
                while r[0] is not None and r[0] in by_entry:
                    r = by_entry[r[0]]
                out.append((first // 64, e, *r))
        return _table(out)

    steps = spread.groupBy("block").applyInArrow(follow, _STEPS)
    n = -(-total // size)
    while n > 1:
        steps = steps.groupBy(F.floor(F.col("block") / 64)).applyInArrow(compose, _STEPS)
        n = -(-n // 64)
    _, _, _, stop, best, has = steps.where("entry = 0").first()
    return stop, best if has else None


def _table(found: list[tuple]) -> pa.Table:
    kinds = {"block": pa.int64(), "entry": pa.int64(), "next": pa.int64(), "stop": pa.string(), "best": pa.float64(), "has_best": pa.bool_()}
    return pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds.values())], list(kinds))
