"""Image features from pixel tables (IM1-IM5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Palette targets as (name, saturation low, best, high, lightness low, best, high).
TARGETS = [
    ("dark vibrant", 0.35, 1.0, 1.0, 0.0, 0.26, 0.45),
    ("vibrant", 0.35, 1.0, 1.0, 0.3, 0.5, 0.7),
    ("light vibrant", 0.35, 1.0, 1.0, 0.55, 0.74, 1.0),
    ("dark muted", 0.0, 0.3, 0.4, 0.0, 0.26, 0.45),
    ("muted", 0.0, 0.3, 0.4, 0.3, 0.5, 0.7),
    ("light muted", 0.0, 0.3, 0.4, 0.55, 0.74, 1.0),
]
SATURATION_WEIGHT, LIGHTNESS_WEIGHT, COUNT_WEIGHT = 3.0, 6.5, 0.5
DARK_FROM, DARK_TO, DARK_FACTOR = 60, 600, 0.35
NEAR, MOST = 900, 5
LIT = 24


def histogram(pixels: DataFrame) -> DataFrame:
    """IM1: five bits per channel; sums and counts are merged before the shuffle."""
    five = lambda c: F.shiftright(F.col(c), 3)
    key = F.shiftleft(five("r"), 10).bitwiseOR(F.shiftleft(five("g"), 5)).bitwiseOR(five("b"))
    return pixels.groupBy("image_id", key.alias("key")).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "rgb"])


def dark_mean(pixels: DataFrame) -> DataFrame:
    light = F.col("r") + F.col("g") + F.col("b")
    rows = pixels.where((light > DARK_FROM) & (light < DARK_TO))
    return rows.groupBy("image_id").agg(*[F.floor(F.sum(c) / F.count("*") * DARK_FACTOR + 0.5).alias(f"dark_{c}") for c in "rgb"])


def shaded(buckets: DataFrame) -> DataFrame:
    """IM2: mean colour, saturation and lightness of each bucket."""
    mean = buckets.withColumns({c: F.col(c) / F.col("n") for c in "rgb"})
    high, low = F.greatest("r", "g", "b") / 255, F.least("r", "g", "b") / 255
    light, span = (high + low) / 2, high - low
    saturation = F.when(span == 0, 0.0).otherwise(span / (1 - F.abs(2 * light - 1)))
    return mean.withColumns({"saturation": saturation, "lightness": light})


def palette(shades: DataFrame) -> DataFrame:
    """IM3: for each target in turn the best bucket in its ranges that no earlier target took.

    A target needs at most its own place plus one candidates, so six per target reach the greedy fold,
    whatever the picture's size.
    """
    most = shades.groupBy("image_id").agg(F.max("n").alias("most"))
    rows = shades.join(most, "image_id")
    fits = []
    for place, (name, s0, s1, s2, l0, l1, l2) in enumerate(TARGETS):
        score = (SATURATION_WEIGHT * (1 - F.abs(F.col("saturation") - s1)) + LIGHTNESS_WEIGHT * (1 - F.abs(F.col("lightness") - l1)) + COUNT_WEIGHT * F.col("n") / F.col("most")) / 10
        fit = F.col("saturation").between(s0, s2) & F.col("lightness").between(l0, l2)
        fits.append(F.when(fit, F.struct(F.lit(place).alias("place"), (-F.round(score, 9)).alias("s"), F.lit(name).alias("target"))))
    spread = rows.select("image_id", "key", "r", "g", "b", F.explode(F.filter(F.array(*fits), lambda f: f.isNotNull())).alias("f"))
    # The filter on the rank becomes a partial top-k before the shuffle.
    rank = F.row_number().over(Window.partitionBy("image_id", "f.place").orderBy("f.s", "f.target", "key", "r", "g", "b"))
    few = spread.withColumn("rank", rank).where(F.col("rank") <= len(TARGETS))
    candidate = F.struct("rank", F.struct("f.s", "f.target", "key", "r", "g", "b").alias("c"))
    best = few.groupBy("image_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("f.place") == k, candidate))).alias(name) for k, (name, *_) in enumerate(TARGETS)])

    def step(taken: Column, candidates: Column) -> Column:
        free = F.filter(candidates, lambda c: ~F.exists(taken, lambda t: t["key"] == c["key"]))
        return F.concat(taken, F.slice(free, 1, 1))

    targets = F.array(*[F.transform(F.col(f"`{name}`"), lambda x: x["c"]) for name, *_ in TARGETS])
    taken = F.aggregate(targets, F.slice(F.get(targets, F.lit(0)), 1, 0), step)
    return best.select("image_id", F.explode(taken).alias("p")).select("image_id", "p.target", "p.key", "p.r", "p.g", "p.b")


def accents(colours: DataFrame) -> DataFrame:
    """IM3: of each palette the vibrant colour, else the most saturated one, in whole numbers."""
    mean = colours.withColumn("n", F.lit(1))
    saturated = shaded(mean)
    order = F.struct((F.col("target") == "vibrant").cast("int"), F.round("saturation", 9), -F.col("key"))
    best = saturated.groupBy("image_id").agg(F.max_by(F.struct("r", "g", "b"), order).alias("c"))
    return best.select("image_id", *[F.floor(F.col(f"c.{c}") + 0.5).alias(c) for c in "rgb"])


def distinct_colours(colours: DataFrame) -> DataFrame:
    """IM4: by lightness, leaving out colours near the last one kept; five at most. A palette has few colours."""
    light = F.greatest("r", "g", "b") + F.least("r", "g", "b")
    listed = colours.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(light.alias("light"), "r", "g", "b"))).alias("cs"))

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        apart = (c["r"] - last["r"]) * (c["r"] - last["r"]) + (c["g"] - last["g"]) * (c["g"] - last["g"]) + (c["b"] - last["b"]) * (c["b"] - last["b"])
        return F.when(last.isNull() | ((apart >= NEAR) & (F.size(acc) < MOST)), F.concat(acc, F.array(c))).otherwise(acc)

    kept = F.aggregate("cs", F.slice("cs", 1, 0), step)
    return listed.select("image_id", F.posexplode(kept).alias("place", "c")).select("image_id", "place", "c.r", "c.g", "c.b")


def letterbox(luma: DataFrame) -> DataFrame:
    """IM5: the lit box of each frame: rows by their mean, then columns within them; per film the tallest, then widest."""
    rows = luma.groupBy("film", "frame", "y").agg(F.floor(F.sum("luma") / F.count("*")).alias("mean")).where(F.col("mean") > LIT)
    lit = rows.groupBy("film", "frame").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    within = luma.join(lit, ["film", "frame"]).where("y BETWEEN top AND bottom")
    columns = within.groupBy("film", "frame", "top", "bottom", "x").agg(F.floor(F.sum("luma") / F.count("*")).alias("mean")).where(F.col("mean") > LIT)
    box = columns.groupBy("film", "frame", "top", "bottom").agg((F.max("x") - F.min("x") + 1).alias("w")).withColumn("h", F.col("bottom") - F.col("top") + 1)
    best = box.groupBy("film").agg(F.max(F.struct("h", "w")).alias("b"))
    return best.select("film", F.col("b.w").alias("w"), F.col("b.h").alias("h"), F.round(F.col("b.w") / F.col("b.h"), 6).alias("aspect"))
