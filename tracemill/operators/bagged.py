"""Random forests of many contexts at once: every (context, tree) grows in the same jobs.

A tree draws every row a number of times (Poisson with mean 1, from a hash of row and tree), so that nobody needs to send its
sample. Features are dealt in at most BINS bins by edges from a bounded sample of a context's rows.

* Nodes of more than LOCAL rows grow level by level: rows pass down the trees, every task adds up histograms of the open
  nodes, and one aggregation a level sums these and picks each node's cut.
* Nodes of at most LOCAL rows are finished in one task, best gain first. Where a whole context has no more rows than that,
  no level is needed.

Rows to fit on are stored once as a few words of 64 bits. A task that grows trees scans the words of its context and keeps the
rows that its trees draw; nothing is dealt out by tree, so disk holds the rows once, whatever the number of trees.
What the driver holds are the trees: contexts x trees x twice the leaves, whatever the number of rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, stored
from .newton import context_runs, places

BINS = 64
LOCAL = 50_000_000  # rows of a node that one task finishes
LOCAL_BYTES = 300_000_000  # and bytes of the words that its trees keep
EDGE_ROWS = 10_000  # rows of a context that the edges of bins come from
HELD = 64_000_000  # bytes of histograms that a task keeps before it sends them on
GROWN = "context_id string, tree int, node int, nodes binary"
#: Cumulative probabilities of a Poisson variable with mean 1.
POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320], float))
STEPS = np.ceil(POISSON * 2**53).astype(np.uint64)  # the same for a draw of 53 bits


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def draws(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree draws each row, from the row's hash."""
    with np.errstate(over="ignore"):
        u = _mix(h.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64) + np.uint64(seed * 0x2545F4914F6CDD1D % 2**64))
    u >>= np.uint64(11)
    out = np.zeros(len(u), np.int64)
    for at in STEPS[:3]:
        out += u >= at
    more = np.flatnonzero(out == 3)
    out[more] = np.searchsorted(STEPS, u[more], "right")
    return out


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """Per column at most BINS - 1 cut places: between neighbouring values where these are few, else quantiles."""
    out = []
    for col in x.T:
        v = np.unique(col)
        out.append((v[1:] + v[:-1]) / 2 if len(v) <= BINS else np.unique(np.quantile(col, np.arange(1, BINS) / BINS)))
    return out


def dealt(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, e in enumerate(edges):
        col = np.ascontiguousarray(x[:, i])
        out[:, i] = np.searchsorted(e, col, "left") if len(e) > 3 else sum((col > v for v in e), np.zeros(len(col), np.uint8)) + len(e) * np.isnan(col)
    return out


def histograms(bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights by column, bin and class; rows by column and bin) of rows that a node holds."""
    m, k = bins.shape
    cell = np.arange(k) * BINS + bins
    weight = np.bincount((cell * 2 + y[:, None]).ravel(), np.repeat(w, k), k * BINS * 2).reshape(k, BINS, 2)
    return weight, np.bincount(cell.ravel(), minlength=k * BINS).reshape(k, BINS)


def best_cut(weight: np.ndarray, rows: np.ndarray, least: int):
    """(gain, column, bin) of the cut that lowers impurity most and leaves ``least`` rows on either side, or None."""
    left, total = weight.cumsum(1)[:, :-1], weight.sum(1, keepdims=True)
    right, n = total - left, rows.cumsum(1)[:, :-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        impure = lambda h: np.nan_to_num(h[..., 0] * h[..., 1] / h.sum(-1))
        gain = 2 * (impure(total) - impure(left) - impure(right))
    gain = np.where((n >= least) & (rows.sum(1, keepdims=True) - n >= least), gain, 0)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-12 else None


def _columns(rng, width: int, few: int) -> np.ndarray:
    return rng.permutation(width)[:few]


def _rng(seed: int, tree: int, node: int):
    return np.random.default_rng([seed, tree, node])


def _order(seed: int, ids: np.ndarray, width: int) -> np.ndarray:
    """For every node, by its number in the whole tree, a random order of the columns that depends on nothing else."""
    with np.errstate(over="ignore"):
        salt = _mix(np.array([seed + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = _mix(ids.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + np.arange(width, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + salt)
    return h.argsort(1, kind="stable")


PACK = float(1 << 27)  # a row counts PACK plus its draws, so that one sum gives both
NODES = 512  # nodes whose histograms are held at once
ALONE = 256  # rows of a node from which it is counted by itself
CHUNK = 1 << 14  # rows counted at once, so that they stay in the cache


@dataclass
class Layout:
    """Where every column's bins stand: number of the byte, shift, bits. Bit 0 of every byte is the label, so that one count of a
    byte gives all of its columns by class."""

    byte: np.ndarray
    shift: np.ndarray
    bits: np.ndarray
    words: int


def layout(tops) -> Layout:
    """Places of columns by their greatest bins, with no more bits than these need; the widest columns are placed first."""
    bits = np.array([int(t).bit_length() for t in tops], np.int64)
    byte, shift, free = np.zeros(len(bits), np.int64), np.ones(len(bits), np.int64), [7]
    for c in np.argsort(-bits, kind="stable").tolist():
        k = next((k for k, n in enumerate(free) if n >= bits[c]), len(free))
        free += [7] * (k == len(free))
        byte[c], shift[c] = k, 8 - free[k]
        free[k] -= bits[c]
    return Layout(byte, shift, bits, -(-len(free) // 8))


def words_of(bins: np.ndarray, y: np.ndarray, lay: Layout) -> np.ndarray:
    """Rows as a few words of eight bytes each: a matrix of words by rows."""
    out = np.zeros((lay.words, len(bins), 8), np.uint8)
    out[:] = y.astype(np.uint8)[None, :, None]
    for c, (k, s) in enumerate(zip(lay.byte.tolist(), lay.shift.tolist(), strict=True)):
        out[k // 8, :, k % 8] |= bins[:, c] << s
    return out.view(np.int64)[:, :, 0]


def _bins(words: np.ndarray, lay: Layout) -> np.ndarray:
    """The bins of rows of words."""
    byte = words.view(np.uint8).reshape(len(words), -1, 8)
    return np.stack([(byte[k // 8, :, k % 8] >> s) & ((1 << n) - 1) for k, s, n in zip(lay.byte.tolist(), lay.shift.tolist(), lay.bits.tolist(), strict=True)], 1)


def _drawn(words: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a tree draws, each once, and their numbers of draws."""
    at = np.flatnonzero(w)
    return words.take(at, 1), w.take(at).astype(np.uint8)


def _spans(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of every row, number of its node) of nodes that begin at lo."""
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(np.arange(len(size)), size)


def _alone(byte, w, cols, lay) -> np.ndarray:
    """Rows and draws of one node by column, bin and class. Columns of one byte are counted together."""
    met = {int(lay.byte[c]): np.zeros(256) for c in cols}
    for a in range(0, len(w), CHUNK):
        weight = w[a : a + CHUNK] + PACK
        for k, m in met.items():
            m += np.bincount(byte[k // 8, a : a + CHUNK, k % 8], weight, 256)
    out = np.zeros((len(cols), 2 * BINS))
    for j, c in enumerate(cols):
        out[j, : 2 << int(lay.bits[c])] = met[int(lay.byte[c])].reshape(-1, 1 << int(lay.bits[c]), 1 << int(lay.shift[c] - 1), 2).sum((0, 2)).ravel()
    return out


def _cells(byte, at, c, lay) -> np.ndarray:
    """Bin and label of a column of each row."""
    k = lay.byte.take(c)
    v = byte.ravel().take(((k >> 3) * byte.shape[1] + at) * 8 + (k & 7)).astype(np.int64)
    return ((v >> (lay.shift - 1).take(c)) & (((1 << lay.bits) - 1) << 1).take(c)) | (v & 1)


def _cuts(words, w, lo, hi, cols, lay, least):
    """(gain, column, bin, draws of the left side by class, its rows) of the best cut of every node among its columns; gain 0 for none."""
    n, few = cols.shape
    sums, size, byte = np.zeros((n, few, 2 * BINS)), hi - lo, words.view(np.uint8).reshape(len(words), -1, 8)
    for i in np.flatnonzero(size >= ALONE).tolist():
        sums[i] = _alone(byte[:, lo[i] : hi[i]], w[lo[i] : hi[i]], cols[i].tolist(), lay)
    small = np.flatnonzero(size < ALONE)
    if len(small):
        at, node = _spans(lo[small], size[small])
        weight = w.take(at) + PACK
        for j in range(few):
            cell = _cells(byte, at, cols[small, j].take(node), lay)
            sums[small, j] = np.bincount(cell + node * (2 * BINS), weight, len(small) * 2 * BINS).reshape(len(small), -1)
    sums = sums.reshape(n, few, BINS, 2)
    rows = np.floor(sums / PACK)
    weight, rows = sums - rows * PACK, rows.sum(-1)
    left, count = weight.cumsum(2), rows.cumsum(2)
    total, every = left[:, :, -1:], count[:, :, -1:]
    left, count = left[:, :, :-1], count[:, :, :-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        impure = lambda h: np.nan_to_num(h[..., 0] * h[..., 1] / (h[..., 0] + h[..., 1]))
        gain = 2 * (impure(total) - impure(left) - impure(total - left))
    gain = np.where((count >= least) & (every - count >= least), gain, 0).reshape(n, -1)
    best, i = gain.argmax(1), np.arange(n)
    f, b = np.divmod(best, BINS - 1)
    top = np.where(gain[i, best] > 1e-12, gain[i, best], 0.0)
    return top, cols[i, f], b, left[i, f, b], count[i, f, b].astype(np.int64)


def _part(words, w, spare, lo, hi, column, cut, lefts, lay) -> None:
    """Put the rows of every node's left side before those of its right side, in place; ``spare`` has room for as many rows."""
    size, byte = hi - lo, words.view(np.uint8).reshape(len(words), -1, 8)
    rows = [*zip(words, spare[0], strict=True), (w, spare[1])]
    for i in np.flatnonzero(size >= ALONE).tolist():
        k, s, m = int(lay.byte[column[i]]), int(lay.shift[column[i]]), (1 << int(lay.bits[column[i]])) - 1
        put, kept = lo[i], 0
        for a in range(lo[i], hi[i], CHUNK):
            b = min(a + CHUNK, hi[i])
            right = ((byte[k // 8, a:b, k % 8] >> s) & m) > cut[i]
            stay, go = np.flatnonzero(~right), np.flatnonzero(right)
            for x, z in rows:
                part = x[a:b]
                z[kept : kept + len(go)] = part.take(go)
                x[put : put + len(stay)] = part.take(stay)
            put, kept = put + len(stay), kept + len(go)
        for x, z in rows:
            x[put : hi[i]] = z[:kept]
    small = np.flatnonzero(size < ALONE)
    if len(small):
        at, node = _spans(lo[small], size[small])
        right = (_cells(byte, at, column[small].take(node), lay) >> 1) > cut[small].take(node)
        before = np.cumsum(right) - right
        before -= before.take(np.cumsum(size[small]) - size[small]).take(node)  # rows of the node that went right already
        to = np.where(right, (lo + lefts)[small].take(node) + before, at - before)
        for x, _ in rows:
            x[to] = x.take(at)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, leaves: int, least: int, rng) -> list[list]:
    """``grow_words`` of the rows that are drawn at least once."""
    lay = layout(bins.max(0) if len(bins) else np.zeros(bins.shape[1]))
    return grow_words(*_drawn(words_of(bins, y, lay), w), lay, depth, leaves, least, rng)


def grow_words(words: np.ndarray, w: np.ndarray, lay: Layout, depth: int, leaves: int, least: int, rng) -> list[list]:
    """Nodes [column or -1, bin, left, right, share of class 1] of a tree grown best gain first, to ``leaves`` leaves.

    All open nodes of a level are cut at once; ``words`` are put in the order of the nodes, so that a node is a range of them.
    Best gain first takes the nodes with the greatest least gain on the way from the root; so a node whose parent's, or whose
    impurity, is below that of enough cuts already known is never taken and stays closed.
    """
    width, seed = len(lay.byte), int(rng.integers(1 << 62))
    few = max(1, int(np.sqrt(width)))
    total = np.zeros(2)
    for a in range(0, len(w), CHUNK):
        total += np.bincount(words[0, a : a + CHUNK] & 1, w[a : a + CHUNK], 2)
    # Of the open nodes: number in the whole tree, place in ``made``, least gain so far, range of rows, draws by class.
    ids, place_, floor = np.ones(1, np.int64), np.zeros(1, np.int64), np.array([np.inf])
    lo, hi, both = np.zeros(1, np.int64), np.full(1, len(w)), total[None, :]
    made = [[0.0, 0.0, 0.0, -1, -1, float(total[1] / total.sum()) if total.sum() else 0.0]]  # least gain, column, bin, children, share
    known, spare = np.zeros(0), (np.empty_like(words), np.empty_like(w))
    for _ in range(depth):
        rows = hi - lo
        bound = np.minimum(floor, 2 * both[:, 0] * both[:, 1] / np.maximum(both.sum(1), 1))
        lowest = np.sort(known)[-(leaves - 1)] if leaves > 1 and len(known) >= leaves - 1 else 0.0
        open_ = (rows >= 2 * least) & (both > 0).all(1) & (bound >= lowest) & (leaves > 1)
        ids, place_, floor, lo, hi, both = (x[open_] for x in (ids, place_, floor, lo, hi, both))
        n = len(ids)
        if not n:
            break
        gain, column, cut, left, lefts = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64), np.zeros((n, 2)), np.zeros(n, np.int64)
        order = _order(seed, ids, width)
        for c in range(0, width, few):  # columns that do not vary are no choice: look further
            todo = np.flatnonzero(gain == 0)
            for p in (todo[k : k + NODES] for k in range(0, len(todo), NODES)):
                gain[p], column[p], cut[p], left[p], lefts[p] = _cuts(words, w, lo[p], hi[p], order[p, c : c + few], lay, least)
        split = gain > 0
        ids, place_, lo, hi, both, column, cut, left, lefts = (x[split] for x in (ids, place_, lo, hi, both, column, cut, left, lefts))
        floor = np.minimum(floor[split], gain[split])
        known = np.concatenate([known, floor])
        _part(words, w, spare, lo, hi, column, cut, lefts, lay)
        both = np.stack([left, both - left], 1).reshape(-1, 2)
        share = both[:, 1] / np.maximum(both.sum(1), 1)
        for i, at in enumerate(place_.tolist()):
            made[at][:5] = [float(floor[i]), int(column[i]), int(cut[i]), len(made), len(made) + 1]
            made += [[0.0, 0.0, 0.0, -1, -1, float(share[2 * i])], [0.0, 0.0, 0.0, -1, -1, float(share[2 * i + 1])]]
        ids, floor = (2 * ids[:, None] + np.arange(2)).ravel(), np.repeat(floor, 2)
        place_ = np.array([made[at][3 + s] for at in place_.tolist() for s in (0, 1)], np.int64)
        lo, hi = np.stack([lo, lo + lefts], 1).ravel(), np.stack([lo + lefts, hi], 1).ravel()
    # The cuts with the greatest least gains, a parent before its children.
    nodes, heap, taken = [[-1, 0, 0, 0, made[0][5]]], [], 1
    offer = lambda at, of: made[of][3] >= 0 and heapq.heappush(heap, (-made[of][0], at, of))
    offer(0, 0)
    while heap and taken < leaves:
        _, at, of = heapq.heappop(heap)
        m = made[of]
        nodes[at][:4] = [m[1], m[2], len(nodes), len(nodes) + 1]
        taken += 1
        for child in m[3:5]:
            nodes.append([-1, 0, 0, 0, made[child][5]])
            offer(len(nodes) - 1, child)
    return nodes


def _pack(nodes) -> bytes:
    return np.array(nodes, "<f8").tobytes()


def place(nodes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node at which each row ends; right children follow the left ones."""
    inner, (n, width) = nodes[:, 0] >= 0, bins.shape
    column, cut = np.where(inner, nodes[:, 0], 0).astype(np.intp), np.where(inner, nodes[:, 1], 255).astype(np.uint8)
    left = np.where(inner, nodes[:, 2], np.arange(len(nodes))).astype(np.intp)
    depth, level = 0, np.zeros(1, np.intp)
    while len(level := level[inner[level]]):
        depth, level = depth + 1, np.concatenate([left[level], left[level] + 1])
    flat, start, at = bins.ravel(), np.arange(n) * width, np.zeros(n, np.intp)
    for _ in range(depth):
        at = left.take(at) + (flat.take(column.take(at) + start) > cut.take(at))
    return at


def prepared(table: DataFrame, key: str, keep: list[str]) -> tuple[DataFrame, dict[str, list[np.ndarray]]]:
    """Rows as bins (context_id, role, kept columns, label, h, bins), stored, and the edges of every context."""
    kept = [k for k in dict.fromkeys([key, "label", *keep])]
    sample = table.filter("role = 'FIT'").select("context_id", "vector", F.xxhash64(F.col(key), F.lit("edges")).alias("h"))
    sizes = {r["context_id"]: r["n"] for r in sample.groupBy("context_id").agg(F.count("*").alias("n")).collect()}
    few = F.lit(False)
    for c, n in sizes.items():
        few = few | ((F.col("context_id") == c) & (F.pmod("h", F.lit(1 << 30)) < int(min(1.0, EDGE_ROWS / n) * (1 << 30))))

    def cut(t: pa.Table) -> pa.Table:
        t = t.sort_by("h")
        x = t["vector"].combine_chunks()
        made = edges_of(x.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1))
        return pa.table({"context_id": t["context_id"].slice(0, 1), "edges": pa.array([[e.tolist() for e in made]], pa.list_(pa.list_(pa.float64())))})

    got = sample.filter(few).groupBy("context_id").applyInArrow(cut, "context_id string, edges array<array<double>>").collect()
    edges = {r["context_id"]: [np.array(e, float) for e in r["edges"]] for r in got}
    sent = table.sparkSession.sparkContext.broadcast(edges)

    def bin_rows(batches):
        for b in batches:
            for c, at, x in context_runs(b):
                if c in sent.value:
                    part = b.take(pa.array(at))
                    yield pa.record_batch([part.column("context_id"), part.column("role"), *[part.column(k) for k in kept], part.column("h"), _binary(dealt(x, sent.value[c]))], ["context_id", "role", *kept, "h", "bins"])

    kinds = ", ".join(f"{k} {dict(table.dtypes)[k]}" for k in kept)
    rows = table.select("context_id", "role", *kept, F.xxhash64(F.col(key)).alias("h"), "vector")
    return stored(rows.mapInArrow(bin_rows, f"context_id string, role string, {kinds}, h long, bins binary")), edges


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of bytes as a column."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])


def _matrix(column) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1), np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def _by_context(batch: pa.RecordBatch):
    for c, at in places(batch.column("context_id")):
        part = batch.take(pa.array(at))
        yield c, _matrix(part.column("bins")), part.column("label").to_numpy(zero_copy_only=False).astype(np.int64), part.column("h").to_numpy()


def _layouts(data: DataFrame) -> dict[str, tuple[int, Layout]]:
    """Number of rows of every context, and the layout that its greatest bins need."""

    def tops(batches):
        held = {}
        for b in batches:
            for c, bins, _, _ in _by_context(b):
                n, top = held.get(c, (0, 0))
                held[c] = n + len(bins), np.maximum(top, bins.max(0))
        if held:
            yield pa.record_batch([pa.array(list(held)), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([t.tobytes() for _, t in held.values()], pa.binary())], ["context_id", "n", "tops"])

    out = {}
    for r in data.mapInArrow(tops, "context_id string, n long, tops binary").collect():  # one line a context and task
        n, top = out.get(r["context_id"], (0, 0))
        out[r["context_id"]] = n + r["n"], np.maximum(top, np.frombuffer(r["tops"], np.uint8))
    return {c: (n, layout(top)) for c, (n, top) in sorted(out.items())}


def _stored_words(data: DataFrame, layouts: dict[str, tuple[int, Layout]]) -> DataFrame:
    """context_id, h, w0, w1, ... of every row, stored in a folder for each context."""
    most = max(lay.words for _, lay in layouts.values())
    names = [f"w{i}" for i in range(most)]

    def run(batches):
        for b in batches:
            out = np.zeros((most, len(b)), np.int64)
            for c, at in places(b.column("context_id")):
                part = b.take(pa.array(at))
                lay = layouts[c][1]
                out[: lay.words, at] = words_of(_matrix(part.column("bins")), part.column("label").to_numpy(zero_copy_only=False), lay)
            yield pa.record_batch([b.column("context_id"), b.column("h"), *[pa.array(x) for x in out]], ["context_id", "h", *names])

    spark, path = data.sparkSession, shared_dir(data.sparkSession)
    kinds = "h long, " + ", ".join(f"{n} long" for n in names)
    data.mapInArrow(run, f"context_id string, {kinds}").write.partitionBy("context_id").option("compression", "zstd").parquet(path)
    return spark.read.schema(f"{kinds}, context_id string").parquet(path)


def _rows_of(batch: pa.RecordBatch, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(words, hashes) of a batch of stored words."""
    return np.stack([batch.column(f"w{i}").to_numpy() for i in range(lay.words)]), batch.column("h").to_numpy()


def _joined(held: list[tuple[np.ndarray, np.ndarray]], lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Drawn rows of many batches in one piece each; the list is emptied on the way."""
    words, w, at = np.empty((lay.words, sum(len(x[1]) for x in held)), np.int64), np.empty(sum(len(x[1]) for x in held), np.uint8), 0
    held.reverse()
    while held:
        x, n = held.pop()
        words[:, at : at + len(n)], w[at : at + len(n)] = x, n
        at += len(n)
    return words, w


APART = "spark.sql.unionOutputPartitioning"


def _collected(parts: list[DataFrame]) -> list:
    """Rows of all parts, each of one task, in one job. Parts are joined in pairs of pairs, as a long chain of unions would be
    analysed again with every link; and Spark must not take parts of one task each for one task together."""
    if not parts:
        return []
    conf = parts[0].sparkSession.conf
    while len(parts) > 1:
        parts = [a[0].union(a[1]) if len(a) == 2 else a[0] for a in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    before = conf.get(APART, None)
    conf.set(APART, "false")
    try:
        return parts[0].collect()
    finally:
        conf.unset(APART) if before is None else conf.set(APART, before)


def fit(rows: DataFrame, trees: int = 150, depth: int = 16, leaves: int = 1024, least: int = 2, seed: int = 7) -> dict[str, list[np.ndarray]]:
    """Trees of every context, as arrays of nodes, grown on the FIT rows of ``prepared``."""
    data = rows.filter("role = 'FIT'").select("context_id", F.col("label").cast("int").alias("label"), "h", "bins")
    layouts = _layouts(data)
    if not layouts:
        return {}
    words, spark = _stored_words(data, layouts), rows.sparkSession
    kept = {c: (8 * lay.words + 1) * 0.65 for c, (_, lay) in layouts.items()}  # bytes a tree keeps of a row: it draws 63 of 100
    most = {c: min(LOCAL, int(LOCAL_BYTES / kept[c])) for c in layouts}
    small, large = [c for c, (n, _) in layouts.items() if n <= most[c]], [c for c, (n, _) in layouts.items() if n > most[c]]
    out: dict[str, dict[int, np.ndarray]] = {c: {} for c in layouts}
    parts = []
    for c in small:
        n, lay = layouts[c]
        # As many trees a task as fit beside each other, but enough tasks for all cores.
        block = max(1, min(int(LOCAL_BYTES / (n * kept[c])), -(-trees * len(small) // (4 * spark.sparkContext.defaultParallelism))))
        own = words.filter(F.col("context_id") == c).drop("context_id").coalesce(1)  # a task reads the files of its context
        for first in range(0, trees, block):

            def whole(batches, c=c, lay=lay, mine=range(first, min(trees, first + block))):
                held = {k: [] for k in mine}
                for b in batches:
                    x, h = _rows_of(b, lay)
                    for k in mine:
                        held[k].append(_drawn(x, draws(h, k, seed)))
                for k in mine:
                    made = grow_words(*_joined(held.pop(k), lay), lay, depth, leaves, least, _rng(seed, k, 0))
                    yield pa.record_batch([pa.array([c]), pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([_pack(made)], pa.binary())], ["context_id", "tree", "node", "nodes"])

            parts.append(own.mapInArrow(whole, GROWN))
    for r in _collected(parts):
        out[r["context_id"]][r["tree"]] = np.frombuffer(r["nodes"], "<f8").reshape(-1, 5)
    if large:
        for c, made in _levels(data.filter(F.col("context_id").isin(large)), words, {c: layouts[c][1] for c in large}, most, trees, depth, leaves, least, seed).items():
            out[c] = made
    return {c: [made[k] for k in sorted(made)] for c, made in out.items()}


def _levels(data: DataFrame, words: DataFrame, layouts: dict[str, Layout], most: dict[str, int], trees: int, depth: int, leaves: int, least: int, seed: int) -> dict[str, dict[int, np.ndarray]]:
    """Trees whose upper nodes grow level by level and whose lower ones are finished where their rows fit in one task."""
    spark, contexts = data.sparkSession, list(layouts)
    grown = {(c, k): [[-1, 0, 0, 0, 0.0]] for c in contexts for k in range(trees)}
    open_ = {(c, k): {0} for c, k in grown}
    local: dict[tuple[str, int], dict[int, int]] = {k: {} for k in grown}  # node: rows
    schema = "context_id string, tree int, node int, cols array<int>, weight binary, rows binary"

    for level in range(depth):
        live = {k: (np.array(grown[k], float), sorted(v)) for k, v in open_.items() if v}
        if not live:
            break
        sent = spark.sparkContext.broadcast(live)

        def partial(batches, sent=sent):
            held, size = {}, 0

            def send():
                keys = list(held)
                yield pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([held[k][0].tolist() for k in keys], pa.list_(pa.int32())), pa.array([held[k][1].tobytes() for k in keys], pa.binary()), pa.array([held[k][2].tobytes() for k in keys], pa.binary())], ["context_id", "tree", "node", "cols", "weight", "rows"])
                held.clear()

            for b in batches:
                for c, bins, y, h in _by_context(b):
                    for (context, k), (nodes, open_nodes) in sent.value.items():
                        if context != c:
                            continue
                        w = draws(h, k, seed)
                        at = np.where(w > 0, place(nodes, bins), -1)
                        for node in open_nodes:
                            mine = np.flatnonzero(at == node)
                            if not len(mine):
                                continue
                            cols = _columns(_rng(seed, k, node), bins.shape[1], max(1, int(np.sqrt(bins.shape[1]))))
                            weight, rows = histograms(bins[np.ix_(mine, cols)], y[mine], w[mine])
                            old = held.get((c, k, node))
                            size += 0 if old else weight.nbytes + rows.nbytes
                            held[c, k, node] = (cols, weight, rows) if old is None else (cols, old[1] + weight, old[2] + rows)
                        if size > HELD:
                            yield from send()
                            size = 0
            if held:
                yield from send()

        def choose(t: pa.Table) -> pa.Table:
            cols = t["cols"][0].as_py()
            weight = sum(np.frombuffer(x, float) for x in t["weight"].to_pylist()).reshape(len(cols), BINS, 2)
            rows = sum(np.frombuffer(x, np.int64) for x in t["rows"].to_pylist()).reshape(len(cols), BINS)
            cut = best_cut(weight, rows, least)
            n, total = int(rows[0].sum()), weight[0].sum(0)
            left = [0, 0.0, 0.0]
            if cut:
                _, f, b = cut
                left = [int(rows[f, : b + 1].sum()), *weight[f, : b + 1].sum(0).tolist()]
            made = (float(cut[0]), int(cols[cut[1]]), int(cut[2])) if cut else (0.0, -1, 0)
            one = lambda v, k: pa.array([v], k)
            return pa.table({"context_id": t["context_id"].slice(0, 1), "tree": t["tree"].slice(0, 1), "node": t["node"].slice(0, 1), "gain": one(made[0], pa.float64()), "col": one(made[1], pa.int32()), "bin": one(made[2], pa.int32()), "n": one(n, pa.int64()), "w0": one(float(total[0]), pa.float64()), "w1": one(float(total[1]), pa.float64()), "ln": one(left[0], pa.int64()), "l0": one(left[1], pa.float64()), "l1": one(left[2], pa.float64())})

        kinds = "context_id string, tree int, node int, gain double, col int, bin int, n long, w0 double, w1 double, ln long, l0 double, l1 double"
        got = data.mapInArrow(partial, schema).groupBy("context_id", "tree", "node").applyInArrow(choose, kinds).collect()
        for k in live:
            open_[k] = set()
        share = lambda a, b: b / (a + b) if a + b else 0.0
        for r in sorted(got, key=lambda r: (-r["gain"], r["context_id"], r["tree"], r["node"])):
            k = r["context_id"], r["tree"]
            nodes = grown[k]
            nodes[r["node"]][4] = share(r["w0"], r["w1"])
            if level == 0 and r["n"] <= most[k[0]]:
                local[k][r["node"]] = r["n"]
                continue
            # Gains come in falling order, so a tree that nears its leaves keeps the best cuts.
            if r["col"] < 0 or (len(nodes) + 1) // 2 >= leaves:
                continue
            at = len(nodes)
            nodes[r["node"]][:4] = [r["col"], r["bin"], at, at + 1]
            for node, n, a, b in ((at, r["ln"], r["l0"], r["l1"]), (at + 1, r["n"] - r["ln"], r["w0"] - r["l0"], r["w1"] - r["l1"])):
                nodes.append([-1, 0, 0, 0, share(a, b)])
                if n < 2 * least or min(a, b) <= 0:
                    continue
                (local[k].__setitem__(node, n) if n <= most[k[0]] else open_[k].add(node))
        sent.unpersist()

    todo = {k: v for k, v in local.items() if v}
    if todo:
        _finish(words, layouts, most, grown, todo, depth, leaves, least, seed)
    out: dict[str, dict[int, np.ndarray]] = {c: {} for c in contexts}
    for (c, k), nodes in grown.items():
        out[c][k] = np.array(nodes, float)
    return out


def _finish(words: DataFrame, layouts: dict[str, Layout], most: dict[str, int], grown: dict, todo: dict, depth: int, leaves: int, least: int, seed: int) -> None:
    """Grow every local node, as many of a tree in a task as fit, and hang its subtree where the node was."""

    def height(nodes):
        at = {0: 0}
        for i, n in enumerate(nodes):
            if n[0] >= 0:
                at[n[2]] = at[n[3]] = at[i] + 1
        return at

    parts = []
    for (c, k), nodes in todo.items():
        free, total, heights, lay = max(0, leaves - (len(grown[c, k]) + 1) // 2), sum(nodes.values()), height(grown[c, k]), layouts[c]
        tasks, held = [], most[c]
        for node, rows in nodes.items():
            if held + rows > most[c]:
                tasks.append({})
                held = 0
            tasks[-1][node] = (1 + int(free * rows / total), depth - heights[node])
            held += rows
        own = words.filter(F.col("context_id") == c).drop("context_id").coalesce(1)
        for wanted in tasks:

            def some(batches, c=c, k=k, lay=lay, tree=np.array(grown[c, k], float), wanted=wanted):
                kept = {n: [] for n in wanted}
                for b in batches:
                    x, h = _rows_of(b, lay)
                    x, w = _drawn(x, draws(h, k, seed))
                    at = place(tree, _bins(x, lay))
                    for n in kept:
                        mine = np.flatnonzero(at == n)
                        kept[n].append((x.take(mine, 1), w.take(mine)))
                for n, (ends, left) in wanted.items():
                    made = grow_words(*_joined(kept.pop(n), lay), lay, left, ends, least, _rng(seed, k, n))
                    yield pa.record_batch([pa.array([c]), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([_pack(made)], pa.binary())], ["context_id", "tree", "node", "nodes"])

            parts.append(own.mapInArrow(some, GROWN))
    got = _collected(parts)
    for r in sorted(got, key=lambda r: (r["context_id"], r["tree"], r["node"])):
        nodes = grown[r["context_id"], r["tree"]]
        made = np.frombuffer(r["nodes"], "<f8").reshape(-1, 5).tolist()
        off = len(nodes) - 1  # its root takes the node's place, the others follow at the end
        moved = [[n[0], n[1], n[2] + off, n[3] + off, n[4]] if n[0] >= 0 else n for n in made]
        nodes[r["node"]] = moved[0]
        nodes += moved[1:]


def score(rows: DataFrame, models: dict[str, list[np.ndarray]], keep: list[str]) -> DataFrame:
    """context_id, keep columns, p_attack (mean share of class 1 over the trees) of every SCORE row of ``prepared``.

    Each context is a scan of its own with its own forest, so a worker holds one forest at a time.
    """
    out = None
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keep)
    for c, forest in models.items():
        sent = rows.sparkSession.sparkContext.broadcast(forest)

        def run(batches, sent=sent, c=c):
            for b in batches:
                bins = _matrix(b.column("bins"))
                p = sum((n[place(n, bins), 4] for n in sent.value), np.zeros(len(bins))) / max(1, len(sent.value))
                yield pa.record_batch([pa.array([c] * len(bins), pa.string()), *[b.column(k) for k in keep], pa.array(p)], ["context_id", *keep, "p_attack"])

        mine = rows.filter((F.col("context_id") == c) & (F.col("role") == "SCORE")).select(*keep, "bins")
        part = mine.mapInArrow(run, f"context_id string, {kinds}, p_attack double")
        out = part if out is None else out.unionByName(part)
    return out
