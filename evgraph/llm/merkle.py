"""Merkle manifest of a dataset: one tree per source, the source roots form the tree of the whole.

A tree is cut into superblocks of FAN ** depth neighbouring nodes. Going up, each superblock is reduced on its own and
only its root travels on; a few rounds of this end at one node a tree. Going down, the nodes of a superblock are
cogrouped with the outer nodes that its members need (the path from the superblock's root to the top), and one
function rebuilds the block, joins the inner path of every member to the outer one and folds the member up to the root.
"""

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evgraph.session import materialize

FAN = 3
DEPTH = 6
# A path is the levels from a node to the root joined by "/"; a level is its left siblings, ".", its right ones, in hex.
ALL = ""
NODE = "tree string, pos long, node string"
OUTER = "tree string, pos long, path string, subroot string, root string"
FOLDED = "pos long, doc_id string, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(column: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value: no two rows frame alike."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def levels(nodes: list[str], first: bool, depth: int) -> list[list[str]]:
    """The nodes of a superblock and those above them: up to one node in a tree's first block, else `depth` levels.

    A first block that is full has its one node after `depth` levels too; one that is not has no block beside it.
    """
    out = [nodes]
    while len(out[-1]) > 1 if first else len(out) <= depth:
        below = out[-1]
        out.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def path_of(above: list[list[str]], at: int) -> list[str]:
    steps = []
    for nodes in above[:-1]:
        start = at - at % FAN
        steps.append("".join(nodes[start:at]) + "." + "".join(nodes[at + 1 : start + FAN]))
        at //= FAN
    return steps


def fold(node: str, path: str) -> str:
    for step in path.split("/") if path else ():
        left, right = step.split(".")
        node = digest(left + node + right)
    return node


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """`pos`: the place of each row in its tree from 0, by `order`. Rows are dealt by range, so no tree has one task
    to itself; rows that tie in everything are dealt at random."""
    dealt = rows.withColumn("_tie", F.rand(0)).repartitionByRange(tree, *order, "_tie").sortWithinPartitions(tree, *order)
    placed = materialize(dealt.drop("_tie").withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy(tree, part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(W.partitionBy(tree).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    shifts = runs.select(tree, "part", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"))
    named = placed.select("*", part).join(shifts, [tree, "part"])
    return named.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FAN**depth}"))


def _roots(nodes: DataFrame, depth: int) -> DataFrame:
    """The superblocks of `nodes` (tree, pos, node) as the nodes of the next round."""

    def up(key, rows):
        members = rows.sort_values("pos")["node"].tolist()
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "node": levels(members, key[1] == 0, depth)[-1]})

    return _blocks(nodes.select("tree", "pos", "node"), depth).groupBy("tree", "block").applyInPandas(up, NODE)


def climbed(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """`nodes` and the roots of their superblocks, round by round, until each tree has one."""
    last = nodes.agg(F.max("pos")).first()[0] or 0
    rounds = [nodes]
    while last > 0:
        last //= FAN**depth
        rounds.append(materialize(_roots(rounds[-1], depth), "superblocks"))
    return rounds


def _members(rows: pd.DataFrame, outer: pd.DataFrame, first: bool, depth: int):
    """The rows of a superblock in order, and the path of each to the root."""
    rows = rows.sort_values("pos")
    above = levels(rows["node"].tolist(), first, depth)
    beyond = outer["path"].iloc[0]
    tail = [beyond] if beyond else []
    return rows, ["/".join(path_of(above, i) + tail) for i in range(len(rows))]


def _paths(nodes: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """The outer nodes of each of `nodes`, from those of their superblocks."""

    def down(key, rows, beyond):
        rows, paths = _members(rows, beyond, key[1] == 0, depth)
        return pd.DataFrame({"tree": key[0], "pos": rows["pos"].tolist(), "path": paths, "subroot": beyond["subroot"].iloc[0], "root": beyond["root"].iloc[0]})

    return _cogrouped(nodes.select("tree", "pos", "node"), outer, depth).applyInPandas(down, OUTER)


def _cogrouped(nodes: DataFrame, outer: DataFrame, depth: int):
    return _blocks(nodes, depth).groupBy("tree", "block").cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block"))


def _folded(leaves: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    def down(key, rows, beyond):
        rows, paths = _members(rows, beyond, key[1] == 0, depth)
        proofs = [p.replace("/", "").replace(".", "") for p in paths]
        return pd.DataFrame({
            "pos": rows["pos"].tolist(), "doc_id": rows["doc_id"].tolist(), "leaf": rows["node"].tolist(),
            "subroot": beyond["subroot"].iloc[0], "root": beyond["root"].iloc[0], "proof": paths, "proof_sha256": [digest(p) for p in proofs],
            "folded_root": [fold(c, p) for c, p in zip(rows["claimed"], paths)],
        })

    return _cogrouped(leaves, outer, depth).applyInPandas(down, FOLDED)


def manifest(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """pos, doc_id, leaf, subroot, root, proof, proof_sha256, folded_root and verified of every row of `rows`.

    `rows` has doc_id, source, leaf (a digest in hex) and claimed (the digest of what a holder has now; null: the same).
    The leaves of a source ascend by doc_id, a null id first, rows of one id by leaf; the subroots of the sources ascend
    by the source's bytes, null first. Rows alike in all of these are leaves of their own. `proof` lists the siblings
    on the way up (see above); folded_root is what `claimed` folds to along it. A source of one row has its leaf as
    subroot, a table of one source its subroot as root. An empty table gives an empty result; other columns are ignored.
    """
    kind = rows.schema["doc_id"].dataType
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree")  # null is before every text
    given = rows.select(tree, "doc_id", F.col("leaf").alias("node"), F.coalesce("claimed", "leaf").alias("claimed"))
    leaves = numbered(materialize(given, "leaves"), "tree", "doc_id", "node").withColumn("doc_id", F.col("doc_id").cast("string"))
    rounds = climbed(leaves, depth)
    subroots = rounds[-1].select(F.lit(ALL).alias("all"), F.col("tree").alias("name"), "node")
    tops = climbed(materialize(numbered(subroots, "all", "name").withColumnRenamed("all", "tree"), "subroots"), depth)
    outer = tops[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(tops[:-1]):
        outer = _paths(nodes, outer, depth)
    first = tops[0].select("pos", F.col("name").alias("tree"), F.col("node").alias("subroot")).join(outer.drop("tree", "subroot"), "pos")
    outer = first.select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    for nodes in reversed(rounds[1:-1]):
        outer = materialize(_paths(nodes, outer, depth), "outer_nodes")
    found = _folded(leaves, outer, depth).withColumn("doc_id", F.col("doc_id").cast(kind))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
