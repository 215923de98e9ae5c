"""Exact top-k search with block-at-a-time pruning.

A component and a sign make a term. Rows are ordered by their strongest terms, then vec_id, and cut into blocks of BLOCK
rows, ranges of that order over the whole table; a block keeps every term's maximum and its forward index (the rows'
components). A query's bound of a block, the sum of its term maxima, limits any score inside.

1. Queries meet the maxima of all blocks, in groups of bounded size, and each keeps its SEEDS blocks of largest bound.
   Scoring those gives it a threshold, the k-th score met.
2. With their thresholds queries meet the maxima again. A segment of SEGMENT rows is sent only to queries that a block of
   it may still serve.
3. There the blocks are scored by descending bound until the next bound falls below the query's k-th score. The k
   best of all segments are the answer. A bound that equals the k-th score is still scored, since ties go to the
   smaller vec_id.

Every query's blocks and how many of them were scored in step 3 are returned. Vectors without structure prune nothing; then every
query meets every segment, in tasks of bounded size.

Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part; vectors meet only
vectors of their length. Whole numbers are exact at any size; a score beyond a long counts as the largest or smallest
long. An empty table gives an empty result; other columns are left out.

Rows may repeat a vec_id. Each distinct (vec_id, scaled vector) is asked once and gets ranks of its own from 1, so a vec_id
with several vectors has several lists under one query_id. Only the asked row itself is left out, by a key of the
stored rows: its copies and other rows of its vec_id are candidates, each a row of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, stored, table

SEGMENT = 8192
BLOCK = 64
QUERIES = 2048
SEEDS = 4
GROUP = 4096  # blocks whose maxima meet a part of the queries in one task
_LONG = 2**63 - 1


class Blocks:
    """Forward indexes of blocks and their term maxima. Each block: ids, keys and scaled components of its rows."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.sizes = np.array([len(b[0]) for b in blocks])
        m, wide, d = len(blocks), int(self.sizes.max()), blocks[0][2].shape[1]
        self.real = np.arange(wide) < self.sizes[:, None]
        self.ids, self.keys = np.zeros((m, wide), np.int64), np.zeros((m, wide), np.int64)
        self.x = np.zeros((m, wide, d), blocks[0][2].dtype)
        self.ids[self.real], self.keys[self.real] = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
        self.x[self.real] = np.concatenate([b[2] for b in blocks])
        self.high = np.array([b[2].max(0) for b in blocks], self.x.dtype).reshape(m, d)
        self.low = np.array([b[2].min(0) for b in blocks], self.x.dtype).reshape(m, d)


def whole_numbers(vectors: np.ndarray, scale: float = 1024.0) -> np.ndarray:
    """floor(scale * x), as doubles where those are exact, else as Python's numbers."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors * scale)
    if np.isfinite(x).all() and np.abs(x).max(initial=0) < 2.0**52:
        return x
    return np.array([[math.floor(c * scale) if abs(c * scale) < 2.0**60 else int(c) * int(scale) for c in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def bounds_of(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima of every query and block, limited to longs."""
    if q.dtype == object or high.dtype == object or float(np.abs(q).max(initial=0)) * max(float(np.abs(high).max(initial=0)), float(np.abs(low).max(initial=0))) * max(q.shape[1], 1) >= 2.0**52:
        q, high, low = q.astype(object), high.astype(object), low.astype(object)
        return np.clip(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T, -_LONG, _LONG)
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def search(q: np.ndarray, own: np.ndarray, at: Blocks, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among the blocks' rows or -1, score) of the k best of each query, best first, and the blocks scored.

    ``own`` holds the queries' keys, which are left out; scores below a query's ``floor`` need not be found.
    """
    m, wide, d = at.x.shape
    n = m * wide
    exact = q.dtype != object and at.x.dtype != object and float(np.abs(q).max(initial=0)) * float(np.abs(at.x).max(initial=0)) * max(d, 1) * (2 * n + 2) < 2.0**52
    q, x = (q, at.x) if exact else (q.astype(object), at.x.astype(object))
    bounds = bounds_of(q, at.high, at.low)
    by_bound = np.argsort(-bounds, axis=1, kind="stable")
    order = np.argsort(np.where(at.real, at.ids, _LONG).ravel(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    ranks = rank.reshape(m, wide)
    kind = np.int64 if exact else object
    none = -(2**62) if exact else -(10**40)
    best = np.full((len(q), k), none, kind)  # score * n + (n - 1 - rank): larger is better
    least = np.full(len(q), none, kind) if floor is None else np.array([none if f is None else f for f in floor.tolist()], kind)
    scored = np.zeros(len(q), np.int64)
    for step in range(m):
        chosen = by_bound[:, step]
        bound = bounds[np.arange(len(q)), chosen]
        worst = np.where(best[:, -1] == none, none, best[:, -1] // n)
        live = np.flatnonzero(bound >= np.maximum(worst, least))
        if not len(live):
            break
        scored[live] += 1
        for lo in range(0, len(live), 256):
            a = live[lo : lo + 256]
            c = chosen[a]
            scores = np.einsum("abd,ad->ab", x[c], q[a]) if exact else np.clip((x[c] * q[a][:, None, :]).sum(2), -_LONG, _LONG)
            worth = scores.astype(kind) * n + (n - 1 - ranks[c])
            worth[~at.real[c] | (at.keys[c] == own[a][:, None])] = none
            best[a] = -np.sort(-np.concatenate([best[a], worth], 1), axis=1)[:, :k]
    there = best != none
    scores = np.where(there, best // n, 0)
    return np.where(there, order[np.where(there, n - 1 - (best - scores * n), 0).astype(np.int64)], -1), scores, scored


def prune_and_score(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, block: int = BLOCK, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``rows`` and scores of the k best of each query, over rows cut into blocks by signs, then id."""
    signs = rows[:, : min(rows.shape[1], 12)] > 0
    order = np.lexsort((ids, signs @ (1 << np.arange(signs.shape[1]))))
    keys = ids if keys is None else keys
    cut = [order[i : i + block] for i in range(0, len(order), block)]
    at = Blocks([(ids[c], keys[c], whole_numbers(rows[c], 1.0)) for c in cut])
    found, scores, _ = search(whole_numbers(queries, 1.0), own, at, k)
    place = np.zeros(at.real.shape, np.int64)
    place[at.real] = order
    return np.where(found >= 0, place.ravel()[found], -1), scores


def _cut_blocks(scale: float):
    """Blocks from rows in order: lengths never mix, and a block is BLOCK rows but for the last one."""

    def run(batches):
        from pyspark import TaskContext

        seg, number, rest = TaskContext.get().partitionId(), 0, None

        def packed(t: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            out = []
            for d, own in t.groupby("d", sort=True):
                for lo in range(0, len(own), BLOCK):
                    b = own.iloc[lo : lo + BLOCK]
                    x = np.stack(b["v"].to_numpy()).astype(np.float64) if d else np.zeros((len(b), 0))
                    out.append((seg, (seg << 24) + number, int(d), b["vec_id"].to_numpy(), b["row_key"].to_numpy(), x.ravel(), x.max(0), x.min(0)))
                    number += 1
            return pd.DataFrame(out, columns=["seg", "block", "d", "ids", "keys", "x", "high", "low"])

        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            # What is before the last length's unfinished block is whole.
            last = int((rest["d"] == rest["d"].iloc[-1]).sum()) if len(rest) else 0
            whole = len(rest) - last % BLOCK
            if whole:
                yield packed(rest.iloc[:whole])
            rest = rest.iloc[whole:]
        if rest is not None and len(rest):
            yield packed(rest)

    return run


_BLOCKS = "seg int, block long, d int, ids array<long>, keys array<long>, x array<double>, high array<double>, low array<double>"


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.stack(column.to_numpy()).reshape(len(column), d).astype(np.float64) if d else np.zeros((len(column), 0))


def _forward(t: pd.DataFrame, d: int, scale: float) -> Blocks:
    return Blocks([(np.asarray(i), np.asarray(k), whole_numbers(np.asarray(x, np.float64).reshape(len(i), d), scale)) for i, k, x in zip(t["ids"], t["keys"], t["x"], strict=True)])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, blocks_scored and blocks (of the query, over all segments) for each
    distinct (vec_id, vector) whose vec_id is divisible by ``every``."""
    factor = float(scale)
    v = only(vectors, "vec_id", "embedding").filter("vec_id is not null and embedding is not null")
    v = v.filter("forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))")
    v = stored(v.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("d"), F.monotonically_increasing_id().alias("row_key")))
    small = F.transform("v", lambda x: F.struct((F.abs(x) < 1e15).alias("s"), F.when(F.abs(x) < 1e15, F.floor(x * factor).cast("double")).otherwise(x).alias("x")))
    asked = stored(v.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "d", small.alias("_w")).agg(F.min(F.struct("row_key", "v")).alias("r")).select("vec_id", "d", "r.row_key", "r.v"))
    segments, parts = max(1, math.ceil(v.count() / SEGMENT)), max(1, math.ceil(asked.count() / QUERIES))
    strongest = F.transform(F.slice(F.array_sort(F.transform("v", lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"), (x > 0).alias("s")))), 1, 3), lambda t: t["i"] * 2 + t["s"].cast("int"))
    ordered = v.withColumn("code", strongest).repartitionByRange(segments, "d", "code", "vec_id", "row_key").sortWithinPartitions("d", "code", "vec_id", "row_key")
    blocks = stored(ordered.select("vec_id", "row_key", "v", "d").mapInPandas(_cut_blocks(factor), _BLOCKS))
    groups = max(1, math.ceil(blocks.count() / GROUP))
    part, group = F.pmod(F.xxhash64("row_key", F.lit(2)), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    asked = asked.withColumn("part", part)
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    each_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    maxima = blocks.select("d", "seg", "block", "high", "low", group.alias("grp"), each_part)

    def seeds(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"asked": pd.Series([], dtype="int64"), "block": pd.Series([], dtype="int64"), "bound": pd.Series([], dtype="float64")})
        d = int(left["d"].iloc[0])
        bounds = bounds_of(whole_numbers(_matrix(left["v"], d), factor), whole_numbers(_matrix(right["high"], d), factor), whole_numbers(_matrix(right["low"], d), factor)).astype(np.float64)
        best = np.argsort(-bounds, axis=1, kind="stable")[:, :SEEDS]
        i = np.repeat(np.arange(len(left)), best.shape[1])
        return pd.DataFrame({"asked": left["row_key"].to_numpy()[i], "block": right["block"].to_numpy()[best.ravel()], "bound": bounds[i, best.ravel()]})

    def thresholds(rows: pd.DataFrame) -> pd.DataFrame:
        """The k-th score of every query over its seeds in one block."""
        d = int(rows["d"].iloc[0])
        at = _forward(rows.iloc[:1], d, factor)
        found, scores, _ = search(whole_numbers(_matrix(rows["v"], d), factor), rows["asked"].to_numpy(), at, k)
        i, j = np.nonzero(found >= 0)
        return pd.DataFrame({"asked": rows["asked"].to_numpy()[i], "score": scores[i, j].astype("int64")})

    def alive(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Segments that hold a block whose bound reaches the query's threshold, and how many blocks there are."""
        if not len(left) or not len(right):
            return pd.DataFrame({"asked": pd.Series([], dtype="int64"), "seg": pd.Series([], dtype="int32")})
        d = int(left["d"].iloc[0])
        bounds = bounds_of(whole_numbers(_matrix(left["v"], d), factor), whole_numbers(_matrix(right["high"], d), factor), whole_numbers(_matrix(right["low"], d), factor))
        floor = np.array([-_LONG if pd.isna(f) else int(f) for f in left["floor"].astype(object)], bounds.dtype)
        segs, at = np.unique(right["seg"].to_numpy(), return_inverse=True)
        i, j = np.nonzero(bounds >= floor[:, None])
        pairs = np.unique(i * len(segs) + at[j])
        return pd.DataFrame({"asked": left["row_key"].to_numpy()[pairs // len(segs)], "seg": segs[pairs % len(segs)].astype("int32")})

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"asked": pd.Series([], dtype="int64"), "query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="Int64"), "score": pd.Series([], dtype="Int64"), "scored": pd.Series([], dtype="int64")})
        d, own = int(left["d"].iloc[0]), left["row_key"].to_numpy()
        floor = np.array([None if pd.isna(f) else int(f) for f in left["floor"].astype(object)], object)
        at = _forward(right, d, factor)
        found, scores, scored = search(whole_numbers(_matrix(left["v"], d), factor), own, at, k, floor)
        i, j = np.nonzero(found >= 0)
        rows = pd.DataFrame({"asked": own[i], "query_id": left["vec_id"].to_numpy()[i], "vec_id": pd.array(at.ids.ravel()[found[i, j]], "Int64"), "score": pd.array(scores[i, j].astype("int64"), "Int64"), "scored": 0})
        counts = pd.DataFrame({"asked": own, "query_id": left["vec_id"].to_numpy(), "vec_id": pd.array([None] * len(own), "Int64"), "score": pd.array([None] * len(own), "Int64"), "scored": scored})
        return pd.concat([rows, counts], ignore_index=True)

    met = ["d", "part", "grp"]
    first = asked.select("*", each_group).groupBy(*met).cogroup(maxima.groupBy(*met)).applyInPandas(seeds, "asked long, block long, bound double")
    best = Window.partitionBy("asked").orderBy(F.desc("bound"), "block")
    first = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= SEEDS).select("asked", "block")
    # A block and a part of its queries make one group, however many queries choose the block.
    queries = asked.select(F.col("row_key").alias("asked"), "v", "part")
    asks = first.join(queries, "asked").join(blocks.select("block", "d", "ids", "keys", "x"), "block")
    kth = asks.groupBy("block", "part").applyInPandas(thresholds, "asked long, score long")
    kth = kth.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score")))).filter(F.col("n") == k).select(F.col("asked").alias("row_key"), F.col("score").alias("floor"))
    asked = stored(asked.join(kth, "row_key", "left"))
    pairs = asked.select("*", each_group).groupBy(*met).cogroup(maxima.groupBy(*met)).applyInPandas(alive, "asked long, seg int").distinct()
    sent = stored(asked.join(pairs, asked["row_key"] == pairs["asked"]).select("seg", "part", "d", "row_key", "vec_id", "v", "floor"))
    needed = sent.select(*[F.col(c).alias(c) for c in ("seg", "part", "d")]).distinct()
    keys = ["seg", "part", "d"]
    found = sent.groupBy(*keys).cogroup(blocks.select("seg", "d", "ids", "keys", "x").join(needed, ["seg", "d"]).groupBy(*keys)).applyInPandas(meet, "asked long, query_id long, vec_id long, score long, scored long")
    order, whole = Window.partitionBy("asked").orderBy(F.col("vec_id").isNull(), F.desc("score"), "vec_id"), Window.partitionBy("asked")
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("blocks_scored", F.sum("scored").over(whole)).filter((F.col("rank") <= k) & F.col("vec_id").isNotNull())
    sizes = blocks.groupBy("d").agg(F.count("*").alias("blocks"))
    ranked = ranked.join(asked.select(F.col("row_key").alias("asked"), "d"), "asked").join(sizes, "d")
    return ranked.select("query_id", "rank", "vec_id", "score", "blocks_scored", "blocks")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
