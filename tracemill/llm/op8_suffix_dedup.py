"""Removal of repeated passages by sorting suffixes.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller doc_id. Deciding this
needs the order of all suffixes, but only where texts have something in common, so the search narrows first:

* Every window of SPAN bytes has an anchor, its GRAM-byte string of smallest hash. Equal windows have equal anchors at
  equal places. Windows that follow each other and share an anchor make a run; there is one for about 14 bytes.
* Texts are dealt to tasks by ranges of doc_id, and a doc_id of many rows may fill several tasks. The first and the last
  doc_id of a task are parts of their own, so two parts hold different doc_ids or the same single one; a part is as
  early as its smallest doc_id (its rank). A part posts its distinct runs (hash of the anchor, hash of the
  run's bytes) to buckets by anchor. A bucket answers for each run: known in a part of lower rank; alone; or an edge, that
  is, its anchor also stands in other bytes. Runs inside a copied passage are known, runs at its ends are edges.
* Edges of an anchor meet as texts. Their windows' suffixes are sorted by deep-shallow sorting, equal neighbours give
  the smallest doc_id of each string, and windows that an earlier document has are marked.
* Each part joins its marks and cuts its texts.

An anchor with very many edges is dealt out by hashes of windows. A part keeps one run of a kind, so a passage that
stands everywhere costs a bucket one entry a part. Texts wait in the shared folder, one file a part.

Runs are told apart by 96 bits of hashes (anchor and bytes), never by fewer; edges are compared byte by byte. Very long texts make a
part of their own. An empty table gives an empty result; other columns are left out.

Null texts are empty. Rows without doc_id neither lose bytes nor count as earlier documents and are only hashed; rows that share a doc_id
do not remove bytes from each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, shared_dir, slices, stored, table, text_bytes
from .deep_shallow import sort_suffixes
from .op10_token_files import _filesystem
from .wordhash import mix

SPAN = 50
GRAM = 24
STEPS = SPAN - GRAM + 1  # places of a window's anchor
EDGES_A_TASK = 4096
KNOWN = 255
PART_BYTES = 32_000_000  # of text in a part; a range of doc_ids, so about
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def runs_of(data: np.ndarray, offsets: np.ndarray):
    """Runs of windows: first and last window, hash of the anchor, hash of the run's bytes; inside texts only."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < SPAN:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    w = np.empty(n - 7, np.uint64)
    for k in range(8):
        v = data[k : k + (n - k) // 8 * 8].view("<u8")
        w[k::8] = v[: len(w[k::8])]
    g = mix(w[:-16] * _A + (w[8:-8] ^ (w[8:-8] >> np.uint64(29))) * _B + w[16:] * _C)
    del w
    low = g
    for k in (1, 2, 4, 8):
        low = np.minimum(low[:-k], low[k:])
    low = np.minimum(low[: -(STEPS - 16)], low[STEPS - 16 :])  # smallest of STEPS
    good = np.ones(n + 1, bool)  # windows inside a text
    reach = (offsets[1:, None] - np.arange(1, SPAN)).ravel()
    good[reach[reach >= 0]] = False
    good = good[: len(low)]
    new = good.copy()
    new[1:] &= ~good[:-1] | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    ends = good.copy()
    ends[:-1] &= ~good[1:] | new[1:]
    last = np.flatnonzero(ends)
    done_first, done_last, done_at = [], [], []
    while len(first):
        at = np.full(len(first), -1)
        value = low[first]
        for k in range(STEPS - 1, -1, -1):
            hit = g[first + k] == value
            at[hit] = first[hit] + k
        stop = np.minimum(last, at)  # equal anchors in a row: the next one takes over behind this one
        done_first.append(first)
        done_last.append(stop)
        done_at.append(at)
        more = last > stop
        first, last = stop[more] + 1, last[more]
    if not done_first:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    first, last, at = (np.concatenate(x) for x in (done_first, done_last, done_at))
    order = np.argsort(first, kind="stable")
    first, last, at = first[order], last[order], at[order]

    def string(p):
        return mix(g[p] * _A + mix(g[p + GRAM] * _B + g[p + SPAN - GRAM] * _C))

    body = mix(string(first) * _A + mix(string(last) * _B + (at - first).astype(np.uint64) * np.uint64(64) + (last - first).astype(np.uint64)))
    return first, last, g[at], body


class Part:
    """Runs of one part of the texts; distinct ones sorted by bucket, anchor and body, the earliest document first."""

    def __init__(self, ids: pa.Array, texts: pa.Array, buckets: int):
        self.data, self.offsets = text_bytes(texts)
        self.has_id = np.array(ids.is_valid())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = [[], [], [], []]
        for lo, hi in slices(self.offsets, 2_000_000):
            base = self.offsets[lo]
            got = runs_of(self.data[base : self.offsets[hi]], self.offsets[lo : hi + 1] - base)
            for x, y in zip(found, (got[0] + base, got[1] + base, got[2], got[3]), strict=True):
                x.append(y)
        kinds = (np.int64, np.int64, np.uint64, np.uint64)
        first, last, anchor, body = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, kinds, strict=True))
        doc = np.searchsorted(self.offsets, first, "right") - 1
        own = self.has_id[doc]
        first, last, anchor, body, doc = first[own], last[own], anchor[own], body[own], doc[own]
        bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((first, body, anchor, bucket))
        self.first, self.last, self.anchor, self.body, self.bucket = first[order], last[order], anchor[order], body[order], bucket[order]
        self.doc = self.ids[doc[order]]
        new = np.ones(len(order), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.body[1:] != self.body[:-1])
        self.kind = np.cumsum(new) - 1  # of every run, its distinct run
        self.lead = np.flatnonzero(new)  # of every distinct run, the run of the earliest document
        self.cuts = np.searchsorted(self.bucket[self.lead], np.arange(buckets + 1))

    def posts(self):
        """(bucket, anchors, bodies) of distinct runs. The bucket fixes some bits, so 32 of the anchor's will do."""
        a, b = self.anchor[self.lead].astype("<u4"), self.body[self.lead].astype("<u8")
        for k in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield k, a[self.cuts[k] : self.cuts[k + 1]], b[self.cuts[k] : self.cuts[k + 1]]

    def settle(self, codes: np.ndarray):
        """Covered ranges of known runs, and the runs that are edges with the log2 of their split."""
        earliest = self.doc[self.lead]
        known = (codes[self.kind] == KNOWN) | (self.doc > earliest[self.kind])
        order = np.argsort(self.first[known], kind="stable")
        ranges = merged(self.first[known][order], self.last[known][order] + SPAN)
        # Anchors that stand in this part alone: an edge if in several bodies and documents.
        a = self.anchor[self.lead]
        same = np.zeros(len(a), bool)
        same[1:] = a[1:] == a[:-1]
        group = np.cumsum(~same) - 1
        size = np.bincount(group, minlength=1)[group] if len(a) else group
        docs_differ = np.zeros(len(a), bool)
        if len(a):
            low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
            every = group[self.kind]
            np.minimum.at(low, every, self.doc)
            np.maximum.at(high, every, self.doc)
            docs_differ = (low != high)[group]
        here = (codes == 0) & (size > 1) & docs_differ
        split = np.where(here, np.ceil(np.log2(np.maximum(1, size / EDGES_A_TASK))), codes.astype(np.int64) - 1).astype(np.int64)
        edge = here | ((codes > 0) & (codes < KNOWN))
        # A document may hold an edge more than once, and each place may lose bytes.
        edges = np.flatnonzero(edge[self.kind] & (self.doc == earliest[self.kind]))
        return ranges, edges, split[self.kind[edges]]


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in ascending order of start, with overlapping ones joined."""
    if not len(start):
        return start, stop
    far = np.maximum.accumulate(stop)
    new = np.append(True, start[1:] > far[:-1])
    return start[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def answers(anchors: np.ndarray, bodies: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For runs of one bucket: KNOWN, 0, or 1 + log2 of the split of an edge. Parts of one rank hold one doc_id."""
    order = np.lexsort((ranks, bodies, anchors))
    a, b, r = anchors[order], bodies[order], ranks[order]
    new_a = np.append(True, a[1:] != a[:-1])
    new_b = new_a | np.append(True, b[1:] != b[:-1])
    first = r == r[np.flatnonzero(new_b)][np.cumsum(new_b) - 1]  # of the lowest rank that has the run
    group = np.cumsum(new_a) - 1
    kinds = np.bincount(group, weights=new_b).astype(np.int64)[group]
    rows = np.bincount(group, weights=first)[group]
    starts = np.flatnonzero(new_a)
    apart = (np.minimum.reduceat(r, starts) != np.maximum.reduceat(r, starts))[group]
    code = np.where(first, np.where((kinds > 1) & apart, 1 + np.ceil(np.log2(np.maximum(1, rows / EDGES_A_TASK))), 0), KNOWN)
    out = np.empty(len(a), np.uint8)
    out[order] = code
    return out


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in (*range(0, SPAN - 8, 8), SPAN - 8):
        h = mix(h * _A + data[at[:, None] + np.arange(k, k + 8)].view("<u8").ravel())
    return h


def _read_part(folder: str, part: int) -> tuple[pa.Array, pa.Array]:
    system, root = _filesystem(folder)
    with system.open_input_file(f"{root}/part-{part:06d}.parquet") as f:
        t = pq.read_table(f)
    return t.column(0).combine_chunks(), t.column(1).combine_chunks()


def _post(folder: str, buckets: int):
    names = ["bucket", "part", "rank", "a", "b"]

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        got = [pa.record_batch([b.column(0), b.column(1).cast(pa.large_string())], ["doc_id", "text"]) for b in batches]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        ids = t.column(0).to_numpy()
        inner, outer = int(np.searchsorted(ids, ids[0], "right")), int(np.searchsorted(ids, ids[-1]))
        for k, (lo, hi) in enumerate(((0, inner), (inner, outer), (max(inner, outer), len(ids)))):
            if lo >= hi:
                continue
            own, part, rank = t.slice(lo, hi - lo), 3 * task.partitionId() + k, int(ids[lo])
            draft = f"{root}/.{part}-{task.taskAttemptId()}"
            with system.open_output_stream(draft) as f:
                pq.write_table(own, f, compression="zstd", use_dictionary=False)
            system.move(draft, f"{root}/part-{part:06d}.parquet")
            posts = list(Part(own.column(0).combine_chunks(), own.column(1).combine_chunks(), buckets).posts())
            yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([part], pa.int32()), pa.array([rank], pa.int64()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], names)
            for at in range(0, len(posts), 16):
                some = posts[at : at + 16]
                yield pa.record_batch([pa.array([k for k, _, _ in some], pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([rank] * len(some), pa.int64()), pa.array([a.tobytes() for _, a, _ in some], pa.binary()), pa.array([b.tobytes() for _, _, b in some], pa.binary())], names)

    return run


def _answer(t: pa.Table) -> pa.Table:
    parts = t.column("part").to_pylist()
    if t.column("bucket")[0].as_py() < 0:
        return pa.table({"part": pa.array(parts, pa.int32()), "bucket": pa.array([-1] * len(parts), pa.int32()), "codes": pa.array([b""] * len(parts), pa.binary())})
    a = [np.frombuffer(x, "<u4") for x in t.column("a").to_pylist()]
    b = [np.frombuffer(x, "<u8") for x in t.column("b").to_pylist()]
    sizes = [len(x) for x in a]
    codes = answers(np.concatenate(a), np.concatenate(b), np.repeat(t.column("rank").to_numpy(), sizes))
    cut = np.append(0, np.cumsum(sizes)).tolist()
    return pa.table({"part": pa.array(parts, pa.int32()), "bucket": t.column("bucket"), "codes": pa.array([codes[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


_SETTLED = "part int, anchor long, sub int, doc_id long, pos long, mask int, bytes binary, stop long"


def _settle(folder: str, buckets: int):
    schema = pa.schema([("part", pa.int32()), ("anchor", pa.int64()), ("sub", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("mask", pa.int32()), ("bytes", pa.binary()), ("stop", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        p = Part(*_read_part(folder, part), buckets)
        by = dict(zip(t.column("bucket").to_pylist(), t.column("codes").to_pylist(), strict=True))
        codes = np.frombuffer(b"".join(by[k] for k in np.flatnonzero(np.diff(p.cuts)).tolist()), np.uint8)
        (start, stop), edges, split = p.settle(codes)
        first, last, doc, anchor = p.first[edges], p.last[edges], p.doc[edges], p.anchor[edges].astype("<u4").astype(np.int64) | p.bucket[edges].astype(np.int64) << 32
        whole = split == 0
        raw = p.data.tobytes()
        subs, pos, masks, owners = [np.zeros(whole.sum(), np.int64)], [first[whole]], [(1 << (last - first + 1)[whole]) - 1], [np.flatnonzero(whole)]
        hot = np.flatnonzero(~whole)
        for lo in range(0, len(hot), 20_000):
            e = hot[lo : lo + 20_000]
            n = (last - first)[e] + 1
            owner = np.repeat(e, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sub = (window_hashes(p.data, first[owner] + step) % (np.uint64(1) << split[owner].astype(np.uint64))).astype(np.int64)
            order = np.lexsort((sub, owner))
            o, s, bits = owner[order], sub[order], 1 << step[order]
            new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (s[1:] != s[:-1])))
            subs.append(s[new])
            pos.append(first[o[new]])
            masks.append(np.add.reduceat(bits, new))
            owners.append(o[new])
        sub, at, mask, owner = (np.concatenate(x) for x in (subs, pos, masks, owners))
        texts = [raw[a:b] for a, b in zip(at.tolist(), (last[owner] + SPAN).tolist(), strict=True)]
        edge_rows = pa.table([pa.array(np.full(len(at), part), pa.int32()), pa.array(anchor[owner]), pa.array(sub, pa.int32()), pa.array(doc[owner]), pa.array(at), pa.array(mask, pa.int32()), pa.array(texts, pa.binary()), pa.nulls(len(at), pa.int64())], schema=schema)
        k = len(start)
        known = pa.table([pa.array(np.full(k, part), pa.int32()), *[pa.nulls(k, f.type) for f in list(schema)[1:4]], pa.array(start), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(stop)], schema=schema)
        return pa.concat_tables([known, edge_rows])

    return run


def _sorted_edges(batches):
    """Marked ranges from edges that come sorted by (anchor, sub): windows that an earlier document has too."""
    rest = None

    def marks(t: pa.Table) -> pa.RecordBatch:
        data, offsets = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8), None
        sizes = np.array([len(x) for x in t.column("bytes").to_pylist()])
        offsets = np.cumsum(sizes) - sizes
        mask, doc = t.column("mask").to_numpy(), t.column("doc_id").to_numpy()
        anchor, sub = t.column("anchor").to_numpy(), t.column("sub").to_numpy()
        group = np.cumsum(np.append(True, (anchor[1:] != anchor[:-1]) | (sub[1:] != sub[:-1])))
        owner, step = np.nonzero((mask[:, None] >> np.arange(STEPS)) & 1)
        order, equal = sort_suffixes(data, offsets[owner] + step, group[owner], SPAN)
        run = np.cumsum(~equal) - 1
        who = doc[owner[order]]
        low = np.minimum.reduceat(who, np.flatnonzero(~equal)) if len(who) else who
        hit = order[who > low[run]] if len(who) else order
        at, part = t.column("pos").to_numpy()[owner[hit]] + step[hit], t.column("part").to_numpy()[owner[hit]]
        by = np.lexsort((at, part))
        at, part = at[by], part[by]
        new = np.flatnonzero(np.append(True, (at[1:] > at[:-1] + SPAN) | (part[1:] != part[:-1]))) if len(at) else at
        ends = np.append(new[1:], len(at)) - 1 if len(at) else new
        return pa.record_batch([pa.array(part[new], pa.int32()), pa.array(at[new]), pa.array(at[ends] + SPAN)], ["part", "pos", "stop"])

    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
        anchor, sub = t.column("anchor").to_numpy(), t.column("sub").to_numpy()
        if not len(anchor):
            continue
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (sub[1:] != sub[:-1])) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield marks(t.slice(0, cut).combine_chunks())
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield marks(rest.combine_chunks())


def _cut(folder: str):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        part = key[0].as_py()
        ids, texts = _read_part(folder, part)
        data, offsets = text_bytes(texts)
        order = np.argsort(right.column("pos").to_numpy(), kind="stable")
        start, stop = merged(right.column("pos").to_numpy()[order], right.column("stop").to_numpy()[order])
        kept, removed, spans = [], [], []
        for lo, hi in slices(offsets, 1_000_000):
            base, top = int(offsets[lo]), int(offsets[hi])
            own = slice(int(np.searchsorted(stop, base, "right")), int(np.searchsorted(start, top)))
            change = np.zeros(top - base + 1, np.int8)
            change[np.maximum(start[own], base) - base] += 1
            change[np.minimum(stop[own], top) - base] -= 1
            gone = np.cumsum(change[:-1], dtype=np.int8) > 0
            at = offsets[lo : hi + 1] - base
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inside = at[:-1][np.diff(at) > 0]
            begins[inside] = gone[inside]
            removed.append(np.diff(np.append(0, np.cumsum(gone))[at]))
            spans.append(np.diff(np.append(0, np.cumsum(begins))[at]))
            part = data[base:top]
            for x, y, r in zip(at[:-1].tolist(), at[1:].tolist(), removed[-1].tolist(), strict=True):
                kept.append(hashlib.sha256((part[x:y][~gone[x:y]] if r else part[x:y]).tobytes()).hexdigest())
        n, removed, spans = np.diff(offsets), np.concatenate(removed or [offsets[:0]]), np.concatenate(spans or [offsets[:0]])
        return pa.table([ids, pa.array(n), pa.array(removed), pa.array(spans), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    # Parts and buckets hold a bounded number of bytes each, even where the session's number of partitions is too small.
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    buckets = 2 * max(8, n_parts)
    text = F.coalesce("text", F.lit(""))
    free = docs.filter("doc_id is null").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    # Rows of one doc_id are spread by their texts, and copies by the partition they come from.
    # The posts are computed in one job, so the parts' files and numbers come from one run of the range split.
    dealt = docs.filter("doc_id is not null").withColumns({"hash": F.xxhash64("text"), "origin": F.spark_partition_id()}).repartitionByRange(n_parts, "doc_id", "hash", "origin")
    parts = dealt.sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    posts = parts.mapInArrow(_post(folder, buckets), "bucket int, part int, rank long, a binary, b binary")
    codes = stored(posts.groupBy("bucket").applyInArrow(_answer, "part int, bucket int, codes binary"))
    settled = stored(codes.groupBy("part").applyInArrow(_settle(folder, buckets), _SETTLED))
    edges = settled.filter("bytes is not null").select("part", "anchor", "sub", "doc_id", "pos", "mask", "bytes")
    marked = edges.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub").mapInArrow(_sorted_edges, "part int, pos long, stop long")
    ranges = settled.filter("bytes is null").select("part", "pos", "stop").unionByName(marked)
    files = codes.filter("bucket = -1").select("part")
    cut = files.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(_cut(folder), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.unionByName(free)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
