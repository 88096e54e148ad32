"""Operator 13: a Merkle manifest of a dataset, with proofs read from a content-addressed store.

1. Leaves: a digest of each row's columns, in the order of ``COLUMNS``.  Rows of a language are
   ranked by ``doc_id``, then leaf, over a range-sorted table, so a language of any size is many tasks.
2. Trees: every ``FAN`` neighbours become their digest until one node, the language's subroot, remains;
   subroots by language become the root in the same way.
3. Store: (height, digest, children), one record for each digest, however often it occurs.
4. Descent: requests for leaves are grouped by the digits of their rank.  From the root on, each reached node
   that leads to a request fetches its record by digest, adds the unselected children to its path, and goes
   on to the selected ones.  A path is split only where its requests part, so a level costs as many rows
   as it has nodes.  At the leaves the path's segments are reversed: siblings next to the leaf come first.

A proof folds a leaf up to the root; :func:`verified` recomputes leaves from a changed table and folds them.

Columns may be null (``-``).  Rows without ``doc_id`` come first, rows without a language are a tree of their
own, the first.  Rows that share a ``doc_id`` are leaves each, by their digests; equal rows are equal leaves.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reelframe.llm.shared import salted_join, written

# What a leaf holds, in order, and how many neighbours make a node.
COLUMNS, FAN, BITS = ["doc_id", "source", "lang", "n_chars", "text"], 8, 3

DIGEST = 64
PATH = "array<struct<digit: int, others: string>>"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """The leaf of a row, with some of its columns replaced."""
    values = [changed.get(c, F.col(c)).cast("string") for c in COLUMNS]
    return hashed(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def tampered(doc_id: str = "doc_id") -> Column:
    """Whether a row of the changed table differs: a third of all ids, by their checksum."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` (the place of their group, null first), ``rank`` in it, and ``size``, the group's rows.

    Rows are sorted by range; each range counts its groups, and only these counts are summed over ranges.
    """
    key = [F.col(group).isNotNull().alias("_known"), F.coalesce(group, F.lit("")).alias("_key")]
    keys = ["_known", "_key"]
    rows = rows.select("*", *key, F.monotonically_increasing_id().alias("_spread"))
    sort = [*keys, *order, "_spread"]
    rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_spread")
    rows = written(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    counts = written(rows.groupBy("_part", *keys).agg(F.count("*").alias("n"), F.min("_row").alias("_first")))
    groups = counts.groupBy(*keys).agg(F.min("_part").alias("_part"), F.sum("n").alias("size"))
    # Running sums over ranges, of which there are as many as tasks.
    opened = groups.groupBy("_part").agg(F.count("*").alias("opened")).withColumn("before", F.expr("coalesce(sum(opened) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"))
    groups = groups.join(opened, "_part").withColumn("tree", F.expr("before + row_number() OVER (PARTITION BY _part ORDER BY _known, _key) - 1")).select(*keys, "tree", "size")
    skipped = counts.withColumn("skip", F.expr("coalesce(sum(n) OVER (PARTITION BY _known, _key ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"))
    places = skipped.join(groups, keys).drop("n")
    return rows.join(places, ["_part", *keys]).withColumn("rank", F.col("_row") - F.col("_first") + F.col("skip")).drop("_part", "_row", "_first", "skip", *keys)


def height_of(size: Column) -> Column:
    """Levels above the leaves: how often ``FAN`` leaves are joined until one node remains."""
    return F.length(F.conv((size - 1).cast("string"), 10, FAN)) - (size == 1).cast("int")


def runs_of(leaves: DataFrame, *more: str) -> DataFrame:
    """Each run of neighbours: (tree, height, idx, members), members by rank with their digests and ``more``."""
    member = F.struct("rank", "digest", *more)
    grouped = leaves.groupBy("tree", "height", F.shiftright("rank", BITS).alias("idx"))
    return grouped.agg(F.sort_array(F.collect_list(member)).alias("members"))


def nodes_of(runs: DataFrame, highest: int) -> list[DataFrame]:
    """Nodes (tree, height, idx, digest, children) of each level, from 1; what is as high as its tree is a root."""
    joined = lambda children: hashed(F.array_join(children, ""))
    children = F.transform("members", lambda m: m["digest"])
    level = runs.where("height >= 1").select("tree", "height", "idx", joined(children).alias("digest"), children.alias("children"))
    levels = [level]
    for k in range(2, highest + 1):
        below = levels[-1].where(F.col("height") >= k).select("tree", "height", F.col("idx").alias("rank"), "digest")
        children = F.transform("members", lambda m: m["digest"])
        level = runs_of(below).select("tree", "height", "idx", joined(children).alias("digest"), children.alias("children"))
        levels.append(level)
    return levels


def build(leaves: DataFrame, *more: str) -> dict[str, DataFrame | int]:
    """The trees over ``leaves`` (tree, rank, size, digest): the store, each tree's root, the runs of leaves, and the greatest height."""
    placed = leaves.select("tree", height_of(F.col("size")).cast("int").alias("height"), "rank", "digest", *more)
    runs = written(runs_of(placed, *more))
    highest = runs.agg(F.coalesce(F.max("height"), F.lit(0)).alias("h")).first().h
    levels = [level.withColumn("at", F.lit(k)) for k, level in enumerate(nodes_of(runs, highest), 1)]
    nodes = written(reduce(DataFrame.unionByName, levels))
    store = written(nodes.groupBy(F.col("at").alias("height"), "digest").agg(F.any_value("children").alias("children")))
    lone = runs.where("height = 0").select("tree", "height", F.col("members")[0]["digest"].alias("root"))
    return {"store": store, "roots": nodes.where("at = height").select("tree", "height", F.col("digest").alias("root")).unionByName(lone), "runs": runs, "highest": highest}


def segment(children: str, digit: Column) -> Column:
    """What a path keeps of a record: the selected child's place and the other children's digests, one after another."""
    others = F.concat(F.slice(children, F.lit(1), digit.cast("int")), F.slice(children, (digit + 2).cast("int"), F.lit(FAN)))
    return F.struct(digit.cast("int").alias("digit"), F.array_join(others, "").alias("others"))


def descend(starts: DataFrame, store: DataFrame, wanted: DataFrame, highest: int) -> DataFrame:
    """The wanted runs' nodes with their paths, from the root down.

    ``starts``: (tree, height, digest, path, root) where the descent begins; ``wanted``: (tree, idx) of runs.
    """
    starts = starts.select("tree", "height", F.lit(0).cast("bigint").alias("idx"), "digest", "path", "root")
    reached = starts.where(F.col("height") == max(highest, 1))
    for at in range(highest, 1, -1):
        records = store.where(F.col("height") == at).select("digest", "children")
        found = fetched(written(reached), records)
        below = found.select("tree", "height", F.col("idx").alias("above"), "path", "root", "children", F.posexplode("children").alias("digit", "digest"))
        below = below.select("tree", "height", (F.shiftleft("above", BITS) + F.col("digit")).alias("idx"), "digest", F.concat("path", F.array(segment("children", F.col("digit")))).alias("path"), "root")
        asked = wanted.select("tree", F.shiftright("idx", (at - 2) * BITS).alias("idx")).distinct()
        reached = below.join(asked, ["tree", "idx"], "left_semi").unionByName(starts.where(F.col("height") == at - 1))
    return reached.unionByName(starts.where("height = 0"))


def fetched(reached: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes with their records; equal digests, of which equal rows make many, are salted."""
    return salted_join(reached.withColumn("_by", F.xxhash64("tree", "idx")), records, ["digest"], "_by").drop("_by")


def proofs(starts: DataFrame, built: dict, more: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """A row for each requested leaf: (tree, rank, digest, path, root, ``more``); path segments come from the leaf up.

    ``wanted`` has the requests as (tree, rank); without it every leaf is asked for.
    """
    runs, store = built["runs"], built["store"]
    if wanted is not None:
        asked = wanted.groupBy("tree", F.shiftright("rank", BITS).alias("idx")).agg(F.collect_set("rank").alias("asked"))
        runs = runs.join(asked, ["tree", "idx"]).withColumn("members", F.filter("members", lambda m: F.array_contains("asked", m["rank"]))).drop("asked")
    reached = written(descend(starts, store, runs.select("tree", "idx"), built["highest"]))
    found = fetched(reached.where("height > 0"), store.where("height = 1").select("digest", "children")).select("tree", "idx", "path", "root", "children")
    found = found.unionByName(reached.where("height = 0").select("tree", "idx", "path", "root", F.lit(None).cast("array<string>").alias("children")))
    each = runs.select("tree", "idx", "members").join(found, ["tree", "idx"]).select("tree", "path", "root", "children", F.explode("members").alias("m"))
    digit = F.col("m.rank").bitwiseAND(F.lit(FAN - 1).cast("bigint"))
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(segment("children", digit))))
    return each.select("tree", F.col("m.rank").alias("rank"), F.col("m.digest").alias("digest"), F.reverse(path).alias("path"), "root", *[F.col(f"m.{c}").alias(c) for c in more])


def proof_of(path: str) -> Column:
    return hashed(F.array_join(F.transform(path, lambda s: s["others"]), ""))


def fold(start: Column, path: str) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(node: Column, s: Column) -> Column:
        cut = s["digit"] * DIGEST
        return hashed(F.concat(F.substring(s["others"], F.lit(1), cut), node, F.substring(s["others"], cut + 1, F.lit(DIGEST * FAN))))

    return F.aggregate(path, start, up)


def manifest(leaves: DataFrame, *more: str) -> tuple[str | None, DataFrame, dict]:
    """The root, where descents into the languages' trees begin, and these trees, of ``leaves`` (lang, doc_id, digest)."""
    trees = build(ranked(leaves, "lang", ["doc_id", "digest"]), *more)
    subroots = written(trees["roots"])
    top = build(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.lit(subroots.count()).alias("size"), F.col("root").alias("digest")))
    begin = top["roots"].select("tree", "height", F.col("root").alias("digest"), F.array().cast(PATH).alias("path"), "root")
    root = begin.select("root").first()
    above = proofs(begin, top, []).select(F.col("rank").alias("tree"), F.col("digest"), F.reverse("path").alias("path"), F.col("digest").alias("root"))
    return root and root.root, written(subroots.select("tree", "height").join(above, "tree")), trees


def leaves_of(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, digest, changed): each row's leaf, and the leaf of the tampered row where it is one."""
    docs = docs.select(*COLUMNS)
    small = F.translate("text", CAPITALS, SMALL)
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), F.when(tampered(), leaf(text=small)).alias("changed"))


def verified(docs: DataFrame) -> DataFrame:
    """Per row: its leaf, its language's subroot, the root, a digest of its proof, and whether its tampered form still leads to the root."""
    root, starts, trees = manifest(written(leaves_of(docs)), "doc_id", "changed")
    each = proofs(starts, trees, ["doc_id", "changed"])
    rows = each.select("doc_id", F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.lit(root).cast("string").alias("root"), proof_of("path").alias("proof_sha256"), fold(F.coalesce("changed", "digest"), "path").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
