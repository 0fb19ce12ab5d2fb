"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree. At each node every child draws -ln(u) / weight, with u from the md5 of
the key and the child's own label, and the smallest draw wins (weighted rendezvous). A child is
chosen with probability weight / sum of weights, and changing one child's weight only moves rows
into it (when it grows) or out of it (when it shrinks); rows whose path meets no changed weight
stay. Draws depend on key and label only, so reruns and any partitioning agree.

Edge cases: a null key is one more key value (all its rows share a shard); a null text has size 8
and the crc of no bytes; repeated rows get places next to each other; a very long text counts with all its bytes; of
equal draws the child that comes first wins; an empty table gives no rows;
columns of the input that the result also names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_total, spread, unit_draw

#: Sub-buckets of a shard for gapless places; only one sub-bucket's rows meet in a task.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    label: str
    weight: float
    children: tuple["Node", ...] = field(default=())
    shard: int = -1

    @staticmethod
    def group(label: str, children: list["Node"]) -> "Node":
        """A node that weighs what its children weigh together."""
        return Node(label, sum(c.weight for c in children), tuple(children))


def uniform_tree(shards: int, region: int = 12, rack: int = 4) -> Node:
    """``shards`` equal shards: racks of ``rack`` shards within regions of ``region`` shards."""
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(shards):
        leaf = Node(f"s{s}", 1.0, (), s)
        regions.setdefault(s // region, {}).setdefault(s % region // rack, []).append(leaf)
    return Node.group(
        "root",
        [
            Node.group(f"g{g}", [Node.group(f"g{g}/r{r}", leaves) for r, leaves in racks.items()])
            for g, racks in regions.items()
        ],
    )


def shards_of(tree: Node) -> list[int]:
    return [s for c in tree.children for s in shards_of(c)] if tree.children else [tree.shard]


def with_shard(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own: no weight beside or above it changes but the root's, which
    takes no part in draws, so for any number of shards the new one alone receives rows. Shards that came so can be
    gathered into regions of several by building a tree anew, which moves rows once."""
    n, label = max(shards_of(tree), default=-1) + 1, f"g{len(tree.children)}"
    while any(c.label == label for c in tree.children):
        label += "+"
    return Node.group(tree.label, [*tree.children, Node.group(label, [Node.group(f"{label}/r0", [Node(f"s{n}", weight, (), n)])])])


def descend(tree: Node, key: Column) -> Column:
    """The shard that ``key`` falls to. The tree is three levels deep at most in the trees built
    here, any depth works; it is a constant of the plan, bounded by the number of shards."""
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def below(node: Node) -> Column:
        if not node.children:
            return F.lit(node.shard)
        if len(node.children) == 1:
            return below(node.children[0])
        draws = [
            F.struct((-F.log(unit_draw(text, c.label)) / F.lit(float(c.weight))).alias("draw"), F.lit(i).alias("child"))
            for i, c in enumerate(node.children)
        ]

        def follow(best: Column) -> Column:
            picked = best["child"]
            chain = F.when(picked == 0, below(node.children[0]))
            for i, c in enumerate(node.children[1:], 1):
                chain = chain.when(picked == i, below(c))
            return chain

        return let(F.array_min(F.array(*draws)), follow)

    return below(tree).cast("int")


def shard(
    df: DataFrame, key: str, tree: Node, grown: Node | None = None, text: str = "text"
) -> DataFrame:
    """Give each row its shard, its place there (gapless from 0) and, with ``grown``, the shard it
    would have in that tree. Returns key, size, text_crc32, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key),
        (F.octet_length(body).cast("bigint") + 8).alias("size"),
        F.crc32(body).alias("text_crc32"),
        descend(tree, F.col(key)).alias("shard"),
        (descend(grown, F.col(key)) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        spread(F.col(key), SLOT_BUCKETS).alias("_bucket"),
    )
    placed = running_total(rows, ["shard"], "_bucket", [key, "size", "text_crc32"], F.lit(1), "slot")
    return placed.withColumn("slot", F.col("slot").cast("bigint")).drop("_bucket")
