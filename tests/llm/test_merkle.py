"""Manifest against a tree built level by level in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evgraph.llm import merkle

SCHEMA = "doc_id long, source string, leaf string, claimed string, pos string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """Root, and for each node its siblings by level as (left, right)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for i, a in enumerate(at):
            run, k = runs[a // 3], a % 3
            proofs[i].append((run[:k], run[k + 1 :]))
        at, nodes = [a // 3 for a in at], [h("".join(r)) for r in runs]
    return nodes[0], proofs


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for s in sources}
    built = {s: plain_tree([r[2] for r in t]) for s, t in trees.items()}
    root, over = plain_tree([built[s][0] for s in sources])
    out = []
    for s, top in zip(sources, over):
        for row, proof in zip(trees[s], built[s][1]):
            steps, node = proof + top, row[3] or row[2]
            for left, right in steps:
                node = h("".join(left) + node + "".join(right))
            siblings = "".join("".join(a) + "".join(b) for a, b in steps)
            out.append((row[0], row[2], built[s][0], root, h(siblings), node, node == root))
    return sorted(out, key=str)


def made(rows, spark, depth):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    found = merkle.manifest(df, depth).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_equals_a_plain_tree(spark, depth):
    sizes = {None: 4, "": 1, "a": 28, "é": 27, "Z": 10, "hot": 100}
    rows = [(n * 7 % 101, s, h(f"{s} {n}"), h("new") if n % 5 == 0 else None) for s, size in sizes.items() for n in range(size)]
    rows += [(None, "a", h("no id"), None), (3, "a", h("x"), None), (3, "a", h("x"), None), (3, "a", h("w"), h("y")), (2**60 + 1, "a", h("big"), h("big"))]
    got = made(rows, spark, depth)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_more_leaves_than_a_superblock(spark):
    rows = [(n, "s" if n % 3 else "t", h(str(n)), None) for n in range(3000)]
    got = made(rows, spark, 6)
    assert got == plain_manifest(rows) and all(r[-1] for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, h("a"), h("b"))], [(1, "s", h("a"), None), (1, "t", h("a"), None)]])
def test_few_rows(spark, rows):
    assert made(rows, spark, 6) == plain_manifest(rows) if rows else made(rows, spark, 6) == []


def test_leaf_frames_its_fields(spark):
    long = "x\n" * 100_000
    rows = [(1, "a", "é"), (None, None, ""), (-2, "", None), (7, "1:a", long)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [r[0] for r in df.select(merkle.leaf(F.col("doc_id"), F.col("source"), F.col("text"))).collect()]
    assert got == [h("1:11:a2:é"), h("--0:"), h("2:-20:-"), h("1:73:1:a200000:" + long)]
