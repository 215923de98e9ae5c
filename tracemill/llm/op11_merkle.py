"""Merkle manifest of a table, with nodes in van Emde Boas order.

Rows become leaves, eight nodes become one, per ``lang`` up to a subroot and over the subroots up to the root. The tree is
cut in aligned subtrees of ``HEIGHT`` steps (4096 leaves). One task builds one subtree and writes it as one row: its
digests lie in van Emde Boas order, that is, a tree is split at half its height, the upper part comes first and the lower
subtrees follow, each laid out likewise. The address of a node is arithmetic on its depth and index, so that a
leaf's siblings and its path lie in few stretches at any size of memory block. The roots of the subtrees are the leaves of
the next level, which is built in the same way, until every group has one node.

Proofs go down again: each level gives the subtrees below it the siblings from there to the root, and the leaves meet
their subtree's row in one task. No task holds more than one subtree, and a lang with a third of all rows is many subtrees.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import global_rank
from .common import dealt_join, only, stored, table

ARITY_BITS = 3  # eight children
HEIGHT = 4  # steps of one stored subtree
DIGEST = 32
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left: string, right: string>>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _nodes(levels: int) -> int:
    return ((1 << ARITY_BITS * levels) - 1) // ((1 << ARITY_BITS) - 1)


@lru_cache(maxsize=256)
def addresses(levels: int, depth: int) -> np.ndarray:
    """Places of all nodes of a depth (the root has 0) in a complete tree of so many levels."""
    index = np.arange(1 << ARITY_BITS * depth)
    if levels == 1:
        return index * 0
    upper = levels // 2
    if depth < upper:
        return addresses(upper, depth)
    low = depth - upper
    return _nodes(upper) + (index >> ARITY_BITS * low) * _nodes(levels - upper) + addresses(levels - upper, low)[index & ((1 << ARITY_BITS * low) - 1)]


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height_of(n: int) -> int:
    """Steps from n nodes to one."""
    steps = 0
    while n > 1:
        n, steps = -(-n >> ARITY_BITS), steps + 1
    return steps


def build(leaves: list[str], height: int) -> bytes:
    """Digests of the subtree over ``leaves`` (lowercase hex), in van Emde Boas order; absent nodes are zeros."""
    out = np.zeros((_nodes(height + 1), DIGEST), np.uint8)
    now = leaves
    for depth in range(height, -1, -1):
        out[addresses(height + 1, depth)[: len(now)]] = np.frombuffer(bytes.fromhex("".join(now)), np.uint8).reshape(-1, DIGEST)
        if depth:
            now = [_hash("".join(now[i : i + (1 << ARITY_BITS)])) for i in range(0, len(now), 1 << ARITY_BITS)]
    return out.tobytes()


class Subtree:
    """Reads siblings of leaves from a stored subtree."""

    def __init__(self, digests: bytes, n: int, height: int):
        self.data, self.height = digests, height
        self.counts = [n]
        for _ in range(height):
            self.counts.append(-(-self.counts[-1] >> ARITY_BITS))
        self.met: dict = {}

    def run(self, up: int, run: int) -> list[str]:
        """Digests of one run of siblings, ``up`` steps above the leaves."""
        if (up, run) not in self.met:
            lo = run << ARITY_BITS
            place = addresses(self.height + 1, self.height - up)[lo : min(lo + (1 << ARITY_BITS), self.counts[up])]
            self.met[up, run] = [self.data[p * DIGEST : (p + 1) * DIGEST].hex() for p in place.tolist()]
        return self.met[up, run]

    def path(self, leaf: int) -> list[tuple[str, str]]:
        """Per level, from below, the siblings left and right of the leaf's ancestor."""
        out = []
        for up in range(self.height):
            run, at = divmod(leaf >> ARITY_BITS * up, 1 << ARITY_BITS)
            nodes = self.run(up, run)
            out.append(("".join(nodes[:at]), "".join(nodes[at + 1 :])))
        return out


def fold(leaf: str, path) -> str:
    """The root that a leaf and the siblings of its path give."""
    for left, right in path:
        leaf = _hash(left + leaf + right)
    return leaf


def levels_of(nodes: DataFrame) -> list[DataFrame]:
    """Stored subtrees of every level above ``nodes`` (grp, pos, node): grp, block, n, height, digests, node (their root).

    Positions are gapless from 0 in each group. At the last level a group is one subtree, whose root is the group's.
    """

    def subtree(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n, block = len(t), t["block"][0].as_py()
        # A full first block is as high as all blocks; one that is not full is its group's only one.
        height = HEIGHT if block or n == 1 << ARITY_BITS * HEIGHT else height_of(n)
        data = build(t["node"].to_pylist(), height)
        return pa.table({"grp": t["grp"].slice(0, 1), "block": pa.array([block]), "n": pa.array([n], pa.int64()), "height": pa.array([height], pa.int32()), "digests": pa.array([data], pa.binary()), "node": pa.array([data[:DIGEST].hex()])})

    out = []
    while True:
        at = nodes.select("grp", "pos", "node", F.shiftright("pos", ARITY_BITS * HEIGHT).alias("block"))
        out.append(stored(at.groupBy("grp", "block").applyInArrow(subtree, "grp string, block long, n long, height int, digests binary, node string")))
        if not out[-1].filter("block > 0").limit(1).count():
            return out
        nodes = out[-1].select("grp", F.col("block").alias("pos"), "node")


def paths_below(level: DataFrame, paths: DataFrame) -> DataFrame:
    """grp, pos, path of every leaf of the level's subtrees, from the paths (grp, block, path) of the subtrees themselves."""

    def down(batches):
        for b in batches:
            for grp, block, n, height, digests, path in zip(*[b.column(c).to_pylist() for c in ("grp", "block", "n", "height", "digests", "path")], strict=True):
                tree = Subtree(digests, n, height)
                rest = [(p["left"], p["right"]) for p in path]
                for lo in range(0, n, 512):
                    at = range(lo, min(lo + 512, n))
                    made = [[{"left": x, "right": y} for x, y in tree.path(i) + rest] for i in at]
                    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
                    yield pa.record_batch([pa.array([grp] * len(at), pa.string()), pa.array([(block << ARITY_BITS * HEIGHT) + i for i in at], pa.int64()), pa.array(made, kind)], ["grp", "pos", "path"])

    joined = level.join(paths, ["grp", "block"]).select("grp", "block", "n", "height", "digests", "path")
    return joined.mapInArrow(down, f"grp string, pos long, path {PATH}")


def _down(levels: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the lowest level's subtrees, from those of the highest's (grp, block, path)."""
    for level in reversed(levels[1:]):
        paths = stored(paths_below(level, paths)).withColumnRenamed("pos", "block")
    return paths


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, grp, leaf and changed, the leaf after tampering (null where none is done); grp orders langs, null first."""
    docs = only(docs, *FIELDS)

    def digest(text):
        held = [F.col(c).cast("string") for c in FIELDS[:-1]] + [text]
        return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in held]), 256)

    lower = F.translate("text", CAPITALS, CAPITALS.lower())
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digest(lower))
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("grp"), digest(F.col("text")).alias("leaf"), changed.alias("changed"))


def manifest(docs: DataFrame) -> dict:
    """The stored manifest of ``docs``: leaves with their positions, the levels of every lang's tree, subroots, and the top.

    Leaves of a lang go by doc_id, null first, rows of equal doc_id by their digest. A null field is ``-``; a null lang is a
    group of its own. An empty table has no leaves and no root; other columns than the five are left out.
    """
    rows = leaves(docs).withColumn("row", F.monotonically_increasing_id())
    ranked = stored(global_rank(rows, ["grp", "doc_id", "leaf", "row"], "rk").drop("row"))
    starts = ranked.groupBy("grp").agg(F.min("rk").alias("start"))
    placed = dealt_join(ranked, starts, "grp", "rk").withColumn("pos", F.col("rk") - F.col("start")).drop("rk", "start")
    levels = levels_of(placed.select("grp", "pos", F.col("leaf").alias("node")))
    subroots = stored(global_rank(levels[-1].select("grp", F.col("node").alias("subroot")), ["grp"], "rk").withColumn("rk", F.col("rk") - 1))
    top = levels_of(subroots.select(F.lit("").alias("grp"), F.col("rk").alias("pos"), F.col("subroot").alias("node")))
    return {"leaves": placed, "levels": levels, "subroots": subroots, "top": top}


def proved(made: dict) -> DataFrame:
    """Per leaf its subroot, the root, the digest of its siblings, the root that the (changed) leaf gives, and whether they agree."""
    spark = made["leaves"].sparkSession
    start = spark.createDataFrame([("", 0, [])], f"grp string, block long, path {PATH}")
    tops = paths_below(made["top"][0], _down(made["top"], start)).select(F.col("pos").alias("rk"), "path")
    langs = made["subroots"].join(tops, "rk").select("grp", F.lit(0).cast("long").alias("block"), "path")
    paths = _down(made["levels"], langs)
    # One row of the top's last level is the root.
    root = made["top"][-1].select(F.col("node").alias("root"))
    blocks = dealt_join(made["levels"][0].join(paths, ["grp", "block"]), made["subroots"].select("grp", "subroot"), "grp", "block").crossJoin(F.broadcast(root))
    blocks = blocks.select("grp", "block", "n", "height", "digests", "path", "subroot", "root")
    rows = made["leaves"].withColumn("block", F.shiftright("pos", ARITY_BITS * HEIGHT))
    kind = made["leaves"].schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        block = right.to_pylist()[0]
        tree, rest = Subtree(block["digests"], block["n"], block["height"]), [(p["left"], p["right"]) for p in block["path"]]
        base, proofs, folded = block["block"] << ARITY_BITS * HEIGHT, [], []
        for pos, leaf, changed in zip(left["pos"].to_pylist(), left["leaf"].to_pylist(), left["changed"].to_pylist(), strict=True):
            path = tree.path(pos - base) + rest
            proofs.append(_hash("".join([x + y for x, y in path])))
            folded.append(fold(changed or leaf, path))
        n = len(left)
        cols = [left["doc_id"], left["leaf"], pa.array([block["subroot"]] * n, pa.string()), pa.array([block["root"]] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == block["root"] for f in folded], pa.bool_())]
        return pa.table(dict(zip(names, cols, strict=True)))

    out = rows.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block"))
    return out.applyInArrow(check, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proved(manifest(table(spark, sf_dir, "documents")))
