"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every text gives its set of shingles (hashed to 64 bits), the set's digest and a signature of COORDINATES minima.
   Equal sets form a class at once, however many copies there are; only classes go on.
2. A class is posted under each coordinate-value pair. Two sets of similarity 0.8 share COORDINATES * 0.8 pairs on
   average and fewer than MATCHES with a probability near 1e-5, so a pair below MATCHES is dropped.
   A pair that shares MATCHES of COORDINATES pairs shares one of the COORDINATES - MATCHES + 1 rarest pairs of
   either class (prefix), and long lists are skipped for all classes that are posted in shorter ones.
3. Inside a list the signatures are compared (collision counts); links that the threshold keeps form clusters. A
   list gives a tree of links, not its pairs. Lists of more than LIST_BLOCK classes are dealt out as pairs of blocks.
4. In each cluster, links are confirmed on full shingle sets, recomputed from one text of each class, found by row
   key: from each class outwards to whatever is left unreached, so a tight group costs about its size.
   Clusters of more than CLUSTER_BLOCK classes are dealt out as pairs of blocks too.

A text without words is empty: n_shingles 0, linked with nothing. Null doc_ids take no part in naming a component.
Rows are told apart by a key that is written with their texts, since doc_ids may be null or repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, with_group
from .common import batch, only, slices, stored, table, text_bytes
from .op2_token_counts import words_of
from .wordhash import hash_words, mix

COORDINATES = 48
MATCHES = 26
LIST_BLOCK = 1024
CLUSTER_BLOCK = 2048
ROW = "_row_key"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240601)
_FLIP = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MULT = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """The sorted distinct shingle hashes of every text."""
    data = _LOWER[data]
    starts, sizes, first = words_of(data, offsets)
    h = hash_words(data, starts, sizes)
    wide = h[: max(0, len(h) - width + 1)]
    for k in range(1, width):
        wide = mix(wide * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(wide)])
    bounds = first.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(wide[a : b - width + 1])
        elif b > a:  # fewer words: the whole sequence is one shingle
            v = np.uint64(b - a)
            for x in h[a:b]:
                v = mix(np.array([v]) * np.uint64(0xD6E8FEB86659FD93) + x)[0]
            yield np.array([v], np.uint64)
        else:
            yield h[:0]


def signature(s: np.ndarray) -> np.ndarray:
    """COORDINATES minima of the set under as many hash functions, 32 bits each."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, ((s[i : i + 4096, None] ^ _FLIP) * _MULT).min(0))
    return (low >> np.uint64(32)).astype("<u4")


def _runs(batches, n_keys: int):
    """Tables of the rows that share the first ``n_keys`` columns, from batches that are sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, bool)
        for c in range(n_keys):
            k = t.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= k[1:] != k[:-1]
        cuts = np.append(0, np.flatnonzero(change))
        yield t.slice(0, int(cuts[-1])), cuts[:-1]
        rest = t.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest, np.array([0])


def _grow(n: int, near, emit) -> None:
    """Reach rows from rows: near(i, left) tells which of ``left`` are linked with i; each reached row is emitted once."""
    left = np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        root = queue[0]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            for j in left[hit].tolist():
                emit(root, j)
                queue.append(j)
            left = left[~hit]


def _list_links(batches):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    for t, cuts in _runs(batches, 3):
        if not t.num_rows:
            continue
        names, sig = t.column("cls").to_pylist(), np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, COORDINATES)
        stops = np.append(cuts[1:], t.num_rows)
        a, b = [], []
        two = cuts[stops - cuts == 2]
        if len(two):
            for lo in range(0, len(two), 50_000):
                part = two[lo : lo + 50_000]
                hit = part[(sig[part] == sig[part + 1]).sum(1) >= MATCHES].tolist()
                a += [names[i] for i in hit]
                b += [names[i + 1] for i in hit]
        for lo, hi in zip(cuts.tolist(), stops.tolist(), strict=True):
            if hi - lo > 2:
                own = sig[lo:hi]

                def emit(i, j, lo=lo):
                    a.append(names[lo + i])
                    b.append(names[lo + j])

                _grow(hi - lo, lambda i, left, own=own: (own[left] == own[i]).sum(1) >= MATCHES, emit)
        yield batch(schema, a, b)


def _confirmed(threshold: int):
    def run(batches):
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        for t, cuts in _runs(batches, 3):
            if not t.num_rows:
                continue
            names, sets, sigs = t.column("cls").to_pylist(), t.column("shingles").to_pylist(), t.column("sig").to_pylist()
            stops = np.append(cuts[1:], t.num_rows)
            a, b = [], []
            for lo, hi in zip(cuts.tolist(), stops.tolist(), strict=True):
                if hi - lo < 2:
                    continue
                parts = [np.frombuffer(s, "<u8") for s in sets[lo:hi]]
                sizes = np.array([len(p) for p in parts])
                _, ids = np.unique(np.concatenate(parts), return_inverse=True)
                at = np.append(0, np.cumsum(sizes))
                mark = np.zeros(ids.max() + 1, bool)

                def near(i, left, ids=ids, at=at, sizes=sizes, mark=mark):
                    hit = np.zeros(len(left), bool)
                    # sets whose sizes alone keep them apart need no look
                    may = np.flatnonzero(100 * np.minimum(sizes[left], sizes[i]) >= threshold * np.maximum(sizes[left], sizes[i]))
                    if not len(may):
                        return hit
                    mark[ids[at[i] : at[i + 1]]] = True
                    for p in range(0, len(may), 512):
                        some = left[may[p : p + 512]]
                        lengths = sizes[some]
                        place = np.repeat(at[some] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
                        both = np.add.reduceat(mark[ids[place]].astype(np.int64), np.append(0, np.cumsum(lengths)[:-1]))
                        hit[may[p : p + 512]] = 100 * both >= threshold * (sizes[i] + lengths - both)
                    mark[ids[at[i] : at[i + 1]]] = False
                    return hit

                def emit(i, j, lo=lo):
                    a.append(names[lo + i])
                    b.append(names[lo + j])

                _grow(hi - lo, near, emit)
            yield batch(schema, a, b)

    return run


def _in_blocks(df: DataFrame, key: str, nb: str) -> DataFrame:
    """Each row once for every pair of blocks of its key that it belongs to: adds i <= j. One block: once, as (0, 0)."""
    s = f"cast(pmod(xxhash64(cls), {nb}) as int)"
    out = df.withColumn("other", F.explode(F.expr(f"sequence(0, cast({nb} as int) - 1)")))
    out = out.withColumn("i", F.expr(f"least({s}, other)")).withColumn("j", F.expr(f"greatest({s}, other)")).drop("other")
    return out.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, written with a key (ROW) of their own."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _labelled(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """ROW, doc_id, n_shingles, component_id and first (the ROW of the component's first row) of rows with ROW.

    First is the smallest doc_id, then the smallest key; rows without doc_id come last. Rows without words: no first.
    """
    docs = only(docs, ROW, "doc_id", "text")
    schema = pa.schema([(ROW, pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("sig", pa.binary())])

    def measure(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            for lo, hi in slices(offsets, 4_000_000):
                n, names, sigs = [], [], []
                for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width):
                    n.append(len(s))
                    names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield batch(schema, b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), n, names, sigs)

    rows = stored(docs.mapInArrow(measure, f"{ROW} long, doc_id long, n_shingles long, cls binary, sig binary"))
    classes = stored(rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("rep"), F.first("sig").alias("sig")))

    # Coordinate-value pairs as one number; a signature is COORDINATES little-endian numbers of 32 bits.
    tokens = classes.select("cls", F.posexplode(F.expr(f"transform(sequence(0, {COORDINATES - 1}), k -> conv(hex(substring(sig, 4 * k + 1, 4)), 16, 10))")).alias("k", "v"))
    tokens = tokens.select("cls", F.expr(f"cast(v as bigint) * {COORDINATES} + k").alias("tok"))
    lists = tokens.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1")
    posted = tokens.join(lists, "tok").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("lists"))  # COORDINATES at most
    # Pairs that no other class has come first in the prefix; they need no list.
    quota = F.expr(f"{COORDINATES - MATCHES + 1} - ({COORDINATES} - size(lists))")
    prefix = posted.filter(quota > 0).withColumn("lists", F.expr(f"slice(lists, 1, {COORDINATES - MATCHES + 1} - ({COORDINATES} - size(lists)))"))
    prefix = prefix.join(classes.select("cls", "sig"), "cls").select(F.explode("lists").alias("l"), "cls", "sig").select("l.tok", F.expr(f"cast((l.c + {LIST_BLOCK - 1}) div {LIST_BLOCK} as int)").alias("nb"), "cls", "sig")
    dealt = _in_blocks(prefix, "tok", "nb").select("tok", "i", "j", "cls", "sig")
    links = dealt.mapInArrow(_list_links, "a binary, b binary")
    clusters = components(links)

    sized = with_group(clusters, "root", "node", {"_n": F.count("*")}, {"nb": F.expr(f"cast((sum(_n) + {CLUSTER_BLOCK - 1}) div {CLUSTER_BLOCK} as int)")})
    members = stored(sized.join(classes.select(F.col("cls").alias("node"), "rep", "sig"), "node").select("root", "nb", F.col("node").alias("cls"), F.col(f"rep.{ROW}").alias(ROW), "sig"))
    texts = docs.join(members, ROW).select("root", "nb", "cls", "sig", "text")  # one row a class
    sets_schema = pa.schema([("root", pa.binary()), ("nb", pa.int32()), ("cls", pa.binary()), ("sig", pa.binary()), ("shingles", pa.binary())])

    def again(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(4))
            for lo, hi in slices(offsets, 4_000_000):
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)]
                part = b.slice(lo, hi - lo)
                yield batch(sets_schema, *[part.column(k) for k in range(4)], sets)

    sets = texts.mapInArrow(again, "root binary, nb int, cls binary, sig binary, shingles binary")
    confirmed = _in_blocks(sets, "root", "nb").select("root", "i", "j", "cls", "sig", "shingles").mapInArrow(_confirmed(threshold), "a binary, b binary")
    groups = components(confirmed)

    named = classes.join(groups, classes["cls"] == groups["node"], "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    labels = with_group(named, "root", "cls", {"_low": F.min("rep")}, {"low": F.min("_low")}).select("cls", F.col("low.doc_id").alias("component_id"), F.col(f"low.{ROW}").alias("first"))
    return rows.join(labels, "cls", "left").select(ROW, "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "first")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    ``width``: words in a shingle. Links: 100 * intersection >= threshold * union, threshold at least 80. Other columns are left
    out, whatever their names; an empty table gives an empty result; very long texts are shingled whole, one at a time.
    """
    out = _labelled(_keyed(only(docs, "doc_id", "text")), width, threshold).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each_group(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each component: its smallest doc_id's, or one without doc_id where none has one. Rows without words stay.

    Of equal doc_ids in a component one row stays; rows of a doc_id in several components are judged by themselves.
    """
    rows = _keyed(docs)
    gone = _labelled(rows, width, threshold).filter(f"first <> {ROW}").select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
