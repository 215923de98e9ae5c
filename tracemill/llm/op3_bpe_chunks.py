"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over eight bytes cuts every text into chunks that do not depend on what stands far before them, so
documents that share a passage share its chunks. A chunk is encoded once and kept while its Python worker has room.
Then the joins are repaired: what a chunk begins with before its first blank and ends with after its last one may be
cut anywhere, so it is encoded again together with its neighbour and one piece more on either side. The new ids must
begin and end with the ids that the chunks have for those pieces; as long as they don't, the window takes one piece
more (up to CONTEXT on a side), and a text with a window that never agrees is encoded whole. Chunks without a blank
belong to the window.

Null and empty texts give no ids; very long texts are encoded whole, one at a time; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe_memo import PieceMemo
from .common import batch, only, slices, table, text_bytes

MASK = np.uint64(511 << 40)  # a cut where nine bits of the hash are zero: every 512 bytes on average
MIX = np.uint64(0x9E3779B97F4A7C15)
LEAST = 64  # bytes in a chunk, but for a text's last one
MOST_CHUNKS = 8_000  # kept in a Python worker; then all are dropped and learnt again
CONTEXT = 3  # pieces on either side of a join that a window takes at most
_CODERS: dict[str, "ChunkCoder"] = {}


def chunk_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted byte positions where chunks start, the starts of all texts included. Cuts lie between characters."""
    n = len(data)
    cuts = [offsets[:-1]]
    if n > 9:
        hit = np.zeros(n, bool)
        for k in range(8):
            words = data[k : k + (n - k) // 8 * 8].view("<u8")
            hit[k + 8 :: 8][: len(words)] = ((words * MIX) & MASK == 0)[: len(hit[k + 8 :: 8])]
        hit &= (data & 0xC0) != 0x80
        cuts.append(np.flatnonzero(hit))
    at = np.unique(np.concatenate(cuts))
    at = at[at < n]
    # Leave out cuts that follow a kept one too closely; a text's start is always kept.
    starts = np.zeros(n + 1, bool)
    starts[offsets[:-1]] = True
    close = np.flatnonzero(np.diff(at, prepend=-LEAST) < LEAST)
    if len(close):
        keep, last = np.ones(len(at), bool), -LEAST
        flags, places = starts[at].tolist(), at.tolist()
        for i, p in enumerate(places):
            if flags[i] or p - last >= LEAST:
                last = p
            else:
                keep[i] = False
        at = at[keep]
    return at


class Chunk(NamedTuple):
    """A chunk with a blank: text before the first one, ids and decoded text of the pieces between, text after the last
    one, and the outermost pieces between with their ids, from the outside in. Without a blank, ``tail`` is None."""

    head: str
    ids: bytes
    text: bytes
    tail: str | None
    first: list[tuple[str, bytes]]
    last: list[tuple[str, bytes]]


class ChunkCoder:
    """Encoded chunks of a tokenizer, and the repair of their joins."""

    def __init__(self, path: str):
        self.memo = PieceMemo(path, "", most=240_000, lower=True, decoded=True)
        self.chunks: dict[bytes, Chunk] = {}

    def learn(self, new: list[bytes]) -> None:
        if len(self.chunks) + len(new) > MOST_CHUNKS:
            self.chunks.clear()
        cut = [c.decode().replace("\n", " ").split(" ") for c in new]
        self.memo.learn({p for pieces in cut for p in pieces if p})
        ids, texts = self.memo.ids, self.memo.texts
        for c, pieces in zip(new, cut, strict=True):
            inner = [p for p in pieces[1:-1] if p]
            first, last = [(p, ids[p]) for p in inner[:CONTEXT]], [(p, ids[p]) for p in inner[: -CONTEXT - 1 : -1]]
            self.chunks[c] = Chunk(pieces[0], b"".join([ids[p] for p in inner]), b" ".join([t for p in inner if (t := texts[p])]), pieces[-1] if len(pieces) > 1 else None, first, last)

    def repaired(self, joins: list[tuple[list, str, list]]) -> list[tuple[bytes, bytes] | None]:
        """Ids and decoded text of what lies between chunks, each (pieces before, text, pieces behind); None where no
        window agrees with the chunks' ids."""
        out: list = [None] * len(joins)
        left = list(range(len(joins)))
        for width in range(1, CONTEXT + 1):
            windows = []
            for i in left:
                before, part, behind = joins[i]
                windows.append(" ".join([*[p for p, _ in before[:width]][::-1], part, *[p for p, _ in behind[:width]]]))
            undone = []
            for i, e in zip(left, self.memo.tok.encode_batch_fast(windows, add_special_tokens=False), strict=True):
                before, _, behind = joins[i]
                ids = array("I", e.ids).tobytes()
                head, tail = b"".join([x for _, x in before[:width]][::-1]), b"".join([x for _, x in behind[:width]])
                if ids.startswith(head) and ids.endswith(tail) and len(ids) >= len(head) + len(tail):
                    own = e.ids[len(head) // 4 : len(e.ids) - len(tail) // 4]
                    out[i] = array("I", own).tobytes(), self.memo.tok.decode(own, skip_special_tokens=False).encode()
                else:
                    undone.append(i)
            left = undone
            if not left:
                break
        return out

    def encode(self, docs: list[list[bytes]]):
        """Ids (little-endian unsigned 32-bit integers) and decoded text of each text, given as its chunks."""
        joins, plans = [], []
        for chunks in docs:
            plan, part, before = [], "", []
            for c in chunks:
                e = self.chunks[c]
                part += e.head
                if e.tail is None:  # no blank in this chunk: the join's window grows over it
                    continue
                if part:
                    plan.append(len(joins))
                    joins.append((before, part, e.first))
                plan.append(e)
                part, before = e.tail, e.last
            if part:
                plan.append(len(joins))
                joins.append((before, part, []))
            plans.append(plan)
        known = self.repaired(joins)
        for chunks, plan in zip(docs, plans, strict=True):
            got = [(x.ids, x.text) if isinstance(x, Chunk) else known[x] for x in plan]
            if None in got:
                whole = self.memo.tok.encode_batch_fast([b"".join(chunks).decode()], add_special_tokens=False)[0].ids
                yield array("I", whole).tobytes(), self.memo.tok.decode(whole, skip_special_tokens=False).encode()
            else:
                yield b"".join([i for i, _ in got]), b" ".join([t for _, t in got if t])


def encode_texts(data: np.ndarray, offsets: np.ndarray, path: str):
    """For every text of the buffer: (ids, decoded text), both as bytes."""
    coder = _CODERS.get(path) or _CODERS.setdefault(path, ChunkCoder(path))
    at = chunk_cuts(data, offsets)
    stops = np.append(at[1:], len(data))
    raw = data.tobytes()
    chunks = [raw[a:b] for a, b in zip(at.tolist(), stops.tolist(), strict=True)]
    first = np.searchsorted(at, offsets).tolist()
    for lo in range(0, len(first) - 1, 200):
        docs = [chunks[first[i] : first[i + 1]] for i in range(lo, min(lo + 200, len(first) - 1))]
        new = list(dict.fromkeys(c for d in docs for c in d if c not in coder.chunks))
        if len(coder.chunks) + len(new) > MOST_CHUNKS:
            new = list(dict.fromkeys(c for d in docs for c in d))
        coder.learn(new)
        yield from coder.encode(docs)


def bpe_encode(docs: DataFrame, tokenizer: str, keep_ids: bool = True) -> DataFrame:
    """Encode and decode whole texts: doc_id, n_tokens, ids (binary; null unless kept), ids_sha256, decoded_sha256.

    A null text is empty and gives no ids; rows with equal doc_ids each give a row; other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets, 2_000_000):
                part = data[offsets[lo] : offsets[hi]]
                ids, n, a, d = [], [], [], []
                for i, t in encode_texts(part, offsets[lo : hi + 1] - offsets[lo], tokenizer):
                    n.append(len(i) // 4)
                    ids.append(i if keep_ids else None)
                    a.append(hashlib.sha256(i).hexdigest())
                    d.append(hashlib.sha256(t).hexdigest())
                yield batch(schema, b.column(0).slice(lo, hi - lo), n, ids, a, d)
            pa.default_memory_pool().release_unused()

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
