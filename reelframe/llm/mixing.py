"""Operator 2: mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Sources share the words of the corpus by weight; a source's target stops at ``MOST`` times its own
words, and what it can't take is shared anew among the others (one pass over the sources in the order
in which they reach that limit).  Each document is due ``target / source words`` copies.  The whole
copies are sure; the fractions are rounded by a tournament: within a block of documents of one source,
two fractions meet, words move at random from one to the other until one of the two is 0 or 1, and the
other goes on; each block's last fraction goes on to the next level, over blocks of blocks.  Moves
keep a source's expected words exactly, and each document's in the mean.  Documents of over 1/32 of their
source's words (31 at most) are rounded first, and the other documents are due what those leave of the
target.  One fraction is left per source and goes to the nearer side, so a source misses its target by
half of one of its smaller documents.

Ties are broken by hashes of ``doc_id``, so reruns agree.  Rows that repeat a (doc_id, source, size) are
documents of their own.  Null text has size 0 and is never taken; a null source is the last source;
null ``doc_id`` is a value like others; an empty table gives no rows; extra columns stay in
:func:`mix_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelframe.llm.shared import written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
#: A document is taken so many times at most.
MOST = 3
#: A document of over 1 / LARGE of its source's words is rounded before the others.
LARGE = 32
#: Fractions that meet in one task, as a mean.
BLOCK = 64


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, n, target) from (source, size).

    One row per source: sources, unlike documents, are few enough to be ranked together.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = totals.withColumn("weight", F.get(weights, place % len(WEIGHTS))).withColumn("limit", F.col("source_size") * float(MOST))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    # The level at which all sources from this one on would share what those before leave over.
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    ranked = ranked.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def _meet(state: Column, x: Column) -> Column:
    """One meeting of the fraction that goes on with the next; words move until one of them is whole."""
    c = state["on"]
    rise = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])
    fall = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])
    up = x["u"] * (rise + fall) < fall
    first_whole = F.when(up, (1 - c["p"]) * c["size"] <= x["p"] * x["size"]).otherwise(c["p"] * c["size"] <= (1 - x["p"]) * x["size"])
    move = F.when(up, rise).otherwise(-fall)
    with_p = lambda s, p: F.struct(s["h"].alias("h"), s["doc_id"].alias("doc_id"), s["k"].alias("k"), s["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), s["u"].alias("u"))
    on = F.when(first_whole, with_p(x, x["p"] - move / x["size"])).otherwise(with_p(c, c["p"] + move / c["size"]))
    done = F.when(first_whole, F.struct(c["doc_id"].alias("doc_id"), c["k"].alias("k"), c["size"].alias("size"), up.cast("int").alias("up"))).otherwise(
        F.struct(x["doc_id"].alias("doc_id"), x["k"].alias("k"), x["size"].alias("size"), (~up).cast("int").alias("up"))
    )
    return F.struct(on.alias("on"), F.concat(state["done"], F.array(done)).alias("done"))


def round_fractions(units: DataFrame, largest: int, seed: int, nearest: bool) -> DataFrame:
    """(source, doc_id, k, size, up) for units (source, n, doc_id, k, size, p); ``largest``: most units of a source.

    The last fraction goes to the nearer side, or else up with its own probability.
    """
    levels = max(1, math.ceil(math.log(max(2, largest), BLOCK)))
    decided = None
    for level in range(levels):
        width = F.lit(1) if level == levels - 1 else F.greatest(F.lit(1), F.ceil(F.col("n") / float(BLOCK ** (level + 1))))
        key = F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "k")
        units = units.withColumn("block", F.pmod(F.xxhash64("doc_id", "k", F.lit(seed)), width.cast("long")))
        unit = F.struct(key.alias("h"), "doc_id", "k", "size", "p", (F.pmod(F.xxhash64(key), F.lit(1 << 52)) / float(1 << 52)).alias("u"))
        block = units.groupBy("source", "n", "block").agg(F.array_sort(F.collect_list(unit)).alias("units"))
        empty = F.array().cast("array<struct<doc_id:bigint,k:bigint,size:bigint,up:int>>")
        fold = F.aggregate(F.slice("units", 2, F.size("units")), F.struct(F.get("units", F.lit(0)).alias("on"), empty.alias("done")), _meet)
        block = written(block.select("source", "n", fold.alias("r")))
        done = block.select("source", F.explode("r.done").alias("d")).select("source", "d.*")
        decided = done if decided is None else decided.union(done)
        units = block.select("source", "n", "r.on.doc_id", "r.on.k", "r.on.size", "r.on.p")
    draw = F.lit(0.5) if nearest else F.pmod(F.xxhash64(F.lit(seed), "doc_id", "k"), F.lit(1 << 52)) / float(1 << 52)
    last = units.select("source", "doc_id", "k", "size", F.when(F.col("p") > draw, 1).otherwise(0).alias("up"))
    return decided.union(last)


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, k, size, source_size, target, copies) per document; ``k`` tells repeated rows apart."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"))
    rows = written(sized.groupBy("doc_id", "source", "size").count())
    counted = rows.groupBy("source", "size").agg(F.sum("count").alias("count"))
    flat = counted.select("source", (F.col("size") * F.col("count")).alias("words"), "count")
    totals = flat.groupBy("source").agg(F.sum("words").alias("size"), F.sum("count").alias("n"))
    targets = written(source_targets(totals.select("source", "size")).drop("n").join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    with_source = lambda df, by: df.join(by.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = with_source(rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("k")), targets)
    large = units.where(F.col("size") * LARGE > F.col("source_size"))
    small = units.where(F.col("size") * LARGE <= F.col("source_size"))
    first = _copies(large, F.col("target") / F.col("source_size"), LARGE, seed, nearest=False)
    took = first.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("took"))
    rest = small.groupBy("source").agg(F.first("target").alias("t"), F.sum("size").alias("words"))
    left = F.greatest(F.lit(0.0), F.least(F.lit(float(MOST)), (F.col("t") - F.coalesce("took", F.lit(0))) / F.nullif(F.col("words"), F.lit(0))))
    left = written(rest.join(took.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce(left, F.lit(0.0)).alias("due")))
    largest = targets.agg(F.max("n")).first()[0] or 0
    return first.union(_copies(with_source(small, left), F.col("due"), largest, seed, nearest=True))


def _copies(units: DataFrame, due: Column, largest: int, seed: int, nearest: bool) -> DataFrame:
    whole = F.when(F.abs(due - F.round(due)) < 1e-9, F.round(due)).otherwise(F.floor(due)).cast("long")
    units = units.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), due - F.col("whole")))
    keys = ["doc_id", "source", "k", "size", "source_size", "target"]
    open_ = (F.col("p") >= 1e-9) & (F.col("size") > 0)
    sure = units.where(~open_).select(*keys, F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("copies"))
    per_source = written(units.groupBy("source").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "whole")]))
    ups = round_fractions(units.where(open_).select("source", "n", "doc_id", "k", "size", "p"), largest, seed, nearest)
    ups = ups.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return written(sure.union(ups.select(*keys, (F.col("whole") + F.col("up")).alias("copies"))))


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("from"), size_of().alias("words"), F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "from", "words").orderBy("tie")).cast("long"))
    taken = mix(docs, seed).where("copies > 0").select("doc_id", "source", "size", "k", "copies")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")) & (F.col("nth") == F.col("k"))
    return rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
