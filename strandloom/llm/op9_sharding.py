"""Placing rows on shards by a weighted hash tree.

A row descends from the root over regions and racks to a shard. At each level
every child draws -ln(u) / weight, u being a hash of the row's key and of the
child's name, and the least draw wins: children get rows in proportion to their
weights, and a change of weights moves rows only between the subtrees whose
weights changed. A further shard is a region of its own, so that rows move
nowhere but into it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents

#: {region: {rack: {shard: weight}}}
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]
SHARDS = 40
#: Rows of one shard are numbered in so many parts.
PARTS = 1024


def tree(shards: int, racks: int = 2, per_rack: int = 5) -> Tree:
    """Equal shards: regions of `racks` full racks, then the rest in a last region."""
    made: dict = {}
    for s in range(shards):
        region, rack = s // (racks * per_rack), s // per_rack
        made.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return made


def grown(before: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    n = 1 + max((s for racks in before.values() for shards in racks.values() for s in shards), default=-1)
    return {**before, f"added{n}": {f"added{n}": {n: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, Mapping) else float(node)


def _children(cluster: Tree) -> list[Column]:
    """For each level a map from a node's path to its children: name, weight and place among them."""
    levels: list[Column] = []
    nodes = {"": cluster}
    while isinstance(next(iter(nodes.values())), Mapping):
        entries = []
        for path, node in nodes.items():
            kept = [(i, f"{path}/{name}", _weight(child)) for i, (name, child) in enumerate(node.items()) if _weight(child) > 0]
            entries += [F.lit(path), F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(i).alias("i"), F.lit(n).alias("path")) for i, n, w in kept])]
        levels.append(F.create_map(*entries))
        nodes = {f"{path}/{name}": child for path, node in nodes.items() for name, child in node.items() if _weight(child) > 0}
    return levels


def place(key: Column, cluster: Tree) -> Column:
    """The shard of a key, by its text: equal integers of any width have one. Subtrees of weight 0 get nothing; a tree of weight 0 is an error."""
    if _weight(cluster) <= 0:
        raise ValueError("the tree has no weight")
    key, path = key.cast("string"), F.lit("")
    for children in _children(cluster):
        draws = F.transform(
            F.element_at(children, path),
            lambda c: F.struct((-F.log((F.shiftrightunsigned(F.xxhash64(key, c["path"]), 11) + 0.5) / float(1 << 53)) / c["weight"]).alias("draw"), c["i"].alias("i"), c["path"].alias("path")),
        )
        path = F.array_min(draws)["path"]
    return F.substring_index(path, "/", -1).cast("int")


def assign(df: DataFrame, cluster: Tree, more: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard by its id, its slot within the shard, and its shard in the tree `more`.

    size is the text's UTF-8 bytes plus 16 and text_crc32 its unsigned checksum;
    a null text counts as empty. Slots of a shard run from 0 without gaps. Rows
    with equal ids (null is an id too) share a shard and get slots of their own;
    shards without rows do not appear, an empty table stays empty. Equal texts
    are not kept together: only the id and the tree decide.
    """
    id_type = df.schema[id_col].dataType
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    placed = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(data) + F.lit(16)).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
    ).select(
        "*",
        place(F.col("id"), cluster).alias("shard"),
        (place(F.col("id"), more) if more else F.lit(None).cast("int")).alias("grown_shard"),
        # By the text too, so that the rows of one id (null, say) are numbered in many parts.
        F.pmod(F.xxhash64(F.col("id").cast("string"), "size", "text_crc32"), F.lit(PARTS)).cast("int").alias("part"),
    )
    # At most shards x PARTS rows: where in its shard each part's slots begin.
    counts = placed.groupBy("shard", "part").count()
    starts = counts.select("shard", "part", (F.sum("count").over(W.partitionBy("shard").orderBy("part")) - F.col("count")).alias("start"))
    within = F.row_number().over(W.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")) - 1
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(starts), ["shard", "part"])
        .select(F.col("id").cast(id_type).alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), "grown_shard")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = tree(SHARDS)
    return assign(documents(spark, sf_dir), cluster, grown(cluster))
