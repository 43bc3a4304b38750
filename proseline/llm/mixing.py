"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

A source's target share makes a rate of copies r for each of its documents: floor(r) whole copies plus a fraction. The
fractions are rounded dependently. Two documents meet; a random amount of words moves from one to the other until one of
them holds none or all of its own words, so the sum of words stays as it is and each document's expected copies stay its
rate. The one that is still fractional goes on to meet the next. Chunks of documents (dealt by a hash of the row, so a
hot source is spread evenly) are folded in an ``aggregate`` expression; their residuals meet in chunks of chunks, level by
level, until one residual is left, which is rounded at random. The words taken from a source then differ from its target by
less than the size of one document. So that this is a short one, documents are folded by size class (powers of two): a source's
class becomes one residual and a reserve of about 64 documents that are left aside; the classes' residuals and reserves are folded
last, from the longest class down, so a long document's fraction is settled against many shorter ones.

Scale: one pass over the texts for the sizes (map-side aggregated to rows of id, source, size), then narrow rows only. Each
level shuffles at most 1/64 of the level before. Rows that repeat (null ids, say) are counted before they are numbered, and more than ``REPEATS``
of one kind are numbered in runs by many tasks. The last fold has about 64 rows for each size class of a source, whatever the
source's size. Source statistics are grouped sums; ranking the sources and filling the targets is a window over one row for each source.

Defined results: a null text has size 0; a document of size 0 takes 0 words; sources sort by code point with null last;
repeated rows (same id, source, size) are each rounded on their own; an empty table gives an empty result; other columns are
ignored. Every choice is a hash of ids and the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

FAN = 64
#: So many repeats of one row are numbered by one task.
REPEATS = 1 << 16
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from rows of source, size.

    Shares in proportion to the weights, cut at ``most`` times a source's size, the excess reshared by weight: the level at
    which sum(min(weight * level, cap)) is the total. Over sources in the order of cap / weight, the level that results if
    all before are cut rises while sources are cut and falls after, so the right one is the largest.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    choose = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", choose).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(min(total, most))) - before) / rest)
    rows = rows.withColumn("level", F.max("level").over(every))
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _uniform(*parts: str) -> str:
    return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) / 9007199254740992.0D)"


def _fold(seed: int) -> str:
    """SQL: folds the array ``docs`` of (h, doc_id, dup, size, x) to the one still fractional and those settled."""
    a, b, none = "acc.cur", "e", "CAST(array() AS array<struct<doc_id:{t},dup:bigint,size:bigint,copies:int>>)"
    up, down = f"least({a}.size - {a}.x, {b}.x)", f"least({a}.x, {b}.size - {b}.x)"
    rises = f"({_uniform(f'{a}.doc_id', f'{a}.dup', f'{b}.doc_id', f'{b}.dup', f'{seed}L')} * ({up} + {down}) < {down})"
    settled = lambda r, copies: f"named_struct('doc_id', {r}.doc_id, 'dup', {r}.dup, 'size', {r}.size, 'copies', {copies})"
    going = lambda r, x: f"named_struct('h', {r}.h, 'doc_id', {r}.doc_id, 'dup', {r}.dup, 'size', {r}.size, 'x', {x})"
    step = lambda cur, done: f"named_struct('cur', {cur}, 'done', array_append(acc.done, {done}))"
    return f"""aggregate(slice(docs, 2, size(docs)), named_struct('cur', docs[0], 'done', {none}), (acc, e) ->
      CASE WHEN {rises} THEN
             CASE WHEN {a}.size - {a}.x <= {b}.x THEN {step(going(b, f'{b}.x - ({a}.size - {a}.x)'), settled(a, 1))}
                  ELSE {step(going(a, f'{a}.x + {b}.x'), settled(b, 0))} END
           ELSE
             CASE WHEN {a}.x <= {b}.size - {b}.x THEN {step(going(b, f'{b}.x + {a}.x'), settled(a, 0))}
                  ELSE {step(going(a, f'{a}.x - ({b}.size - {b}.x)'), settled(b, 1))} END
      END)"""


def numbered(counts: DataFrame) -> DataFrame:
    """The rows of counts (doc_id, source, size, count) each as often as its count says, with dup from 1 up. counts should be a saved table."""
    row, numbers = ["doc_id", "source", "size"], lambda low, high: F.explode(F.sequence(low, high)).alias("dup")
    few = counts.where(F.col("count") <= REPEATS).select(*row, numbers(F.lit(1).cast("long"), F.col("count")))
    runs = counts.where(F.col("count") > REPEATS).select(*row, "count", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / REPEATS))).alias("run"))
    runs = runs.repartition(*row, "run")
    return few.unionByName(runs.select(*row, numbers(F.col("run") * REPEATS + 1, F.least("count", (F.col("run") + 1) * REPEATS))))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (3, 1, 2), total: float = 1.5, most: float = 2.0, seed: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row for each document."""
    scratch = scratch or Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")
    counts = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").count())
    rows = scratch.save(numbered(counts))
    scratch.drop(counts)
    cls = F.floor(F.log2(F.col("size"))).cast("int")
    held = rows.where("size > 0").groupBy("source", cls.alias("cls")).count().groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("cls", "count"))).alias("_held"), F.max("count").alias("_most"))
    share = targets(rows, weights, total, most).select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    share = scratch.save(share.join(held, F.col("_source").eqNullSafe(F.col("source")), "left").drop("source"))
    most_held = share.agg(F.max("_most")).first()[0] or 0
    keys = ["source", "source_size", "target"]
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = rows.join(share, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "dup", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), cls.alias("cls"), F.expr(f"int(ceil(_held[cls] / {FAN}.0D))").alias("width"))
    rows = rows.withColumn("x", F.col("size") * (rate - F.floor(rate)))
    # node 0 of a class is its reserve; the others are the leaves of its tree
    node = F.pmod(F.xxhash64("doc_id", "dup", F.lit(seed)), F.col("width")).cast("int").alias("node")
    open_ = rows.where("x > 0").select(*keys, "cls", node, F.struct(F.xxhash64("doc_id", "dup", F.lit(seed + 1)).alias("h"), "doc_id", "dup", "size", "x").alias("doc"))
    fold = _fold(seed).replace("{t}", rows.schema["doc_id"].dataType.simpleString())
    done = [rows.where("x <= 0").select("doc_id", *keys, "size", F.lit(0).alias("copies"))]
    taken = lambda r: r.select("d.doc_id", *keys, "d.size", "d.copies")
    last, level, width = open_.where("node = 0").drop("node"), open_.where("node > 0").withColumn("node", F.col("node") - 1), -(-most_held // FAN) - 1
    while width > 0:
        level = scratch.save(level.groupBy(*keys, "cls", "node").agg(F.array_sort(F.collect_list("doc")).alias("docs")).select(*keys, "cls", "node", F.expr(fold).alias("r")))
        done.append(taken(level.select(*keys, F.explode("r.done").alias("d"))))
        level = level.select(*keys, "cls", F.floor(F.col("node") / FAN).cast("int").alias("node"), F.col("r.cur").alias("doc"))
        width = 0 if width == 1 else -(-width // FAN)
    last = last.unionByName(level.drop("node")) if most_held > FAN else last
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cls")).alias("down"), "doc"))), lambda d: d["doc"])
    last = scratch.save(last.groupBy(*keys).agg(ordered.alias("docs")).select(*keys, F.expr(fold).alias("r")))
    done.append(taken(last.select(*keys, F.explode("r.done").alias("d"))))
    end = F.expr(f"CASE WHEN {_uniform('r.cur.doc_id', 'r.cur.dup', f'{seed + 2}L')} * r.cur.size < r.cur.x THEN 1 ELSE 0 END")
    done.append(last.select("r.cur.doc_id", *keys, "r.cur.size", end.alias("copies")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.floor(rate) + F.col("copies")).cast("long").alias("copies"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
