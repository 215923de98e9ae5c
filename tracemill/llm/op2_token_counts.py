"""Greedy word-piece counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links: from a node that stands for the characters read so far, to the node
that stands for what is left after the longest pieces are taken off its front, together with how many pieces that
takes off. Followed to the end and written out as one table of (next state, pieces taken off) for every state and
byte, each byte of a word costs one look-up, and no piece is ever built. Words of a batch advance side by side.

Pieces are the byte strings of a byte-level vocabulary; a word is read with the blank before it. A word that the
vocabulary cannot spell counts as one unknown piece. Null texts count 0 words and 0 pieces. Every row gives a row, repeated
doc_ids and null ones too; other columns are left out, whatever their names; an empty table gives an empty result. Texts
are read whole, in slices of a few megabytes of whole texts; one longer text makes a slice alone.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe_memo import byte_signs
from .common import batch, only, slices, table, text_bytes

_AUTOMATA: dict[str, "LongestMatch"] = {}
FAIL = -1


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level tokenizer file as bytes, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {s: b for b, s in enumerate(byte_signs())}
    special = {t["content"] for t in spec["added_tokens"]}
    return [bytes(back[c] for c in v) for v in spec["model"]["vocab"] if v not in special]


class LongestMatch:
    def __init__(self, pieces: list[bytes], lead: bytes = b" "):
        children, depth, is_piece = [{}], [0], [False]
        for p in pieces:
            v = 0
            for b in p:
                u = children[v].get(b)
                if u is None:
                    u = children[v][b] = len(children)
                    children.append({})
                    depth.append(depth[v] + 1)
                    is_piece.append(False)
                v = u
            is_piece[v] = v > 0
        order = [0]
        fail, pops = [FAIL] * len(children), [0] * len(children)
        for v in order:
            for b, u in children[v].items():
                order.append(u)
                if is_piece[u]:
                    fail[u], pops[u] = 0, 1
                    continue
                z, n = fail[v], pops[v]
                while z != FAIL and b not in children[z]:
                    n += pops[z]
                    z = fail[z]
                if z != FAIL:
                    fail[u], pops[u] = children[z][b], n
        # Rows for nodes with children; a leaf is a piece and counts at once, leading to the root.
        inner = [v for v in order if children[v]]
        row = {v: i for i, v in enumerate(inner)}
        k = len(inner)
        self.next = np.full((k + 1, 256), k, np.int32)  # row k: the vocabulary cannot spell the word
        self.took = np.zeros((k + 1, 256), np.uint8)
        self.end = np.zeros(k + 1, np.int32)
        for i, v in enumerate(inner):
            if fail[v] != FAIL:
                f = fail[v]
                back, n = (row[f], pops[v]) if f in row else (0, pops[v] + 1)
                self.next[i], self.took[i] = self.next[back], self.took[back] + np.uint8(n)
                self.end[i] = FAIL if self.end[back] == FAIL else self.end[back] + n
            elif v:
                self.end[i] = FAIL
            for b, u in children[v].items():
                self.next[i, b], self.took[i, b] = (row[u], 0) if u in row else (0, 1)
        self.end[k] = FAIL
        self.flat_next, self.flat_took = self.next.ravel(), self.took.ravel()
        self.start, self.start_count = 0, 0
        for b in lead:
            self.start_count += int(self.took[self.start, b])
            self.start = int(self.next[self.start, b])

    def count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pieces of each of the words data[start : start + size]."""
        total = np.zeros(len(starts), np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        at, left = starts[by_size].astype(np.int64), sizes[by_size]
        state = np.full(len(at), self.start << 8, np.int32)
        got = np.full(len(at), self.start_count, np.int64)
        live = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), "right")
        for k, n in enumerate(live.tolist()):
            if n <= 8:  # a few very long words are left: on, one by one
                for i in range(n):
                    s, c, nxt, took = int(state[i]) >> 8, int(got[i]), self.flat_next, self.flat_took
                    for b in data[at[i] + k : at[i] + left[i]].tolist():
                        j = s << 8 | b
                        c += took[j].item()
                        s = nxt[j].item()
                    state[i], got[i] = s << 8, c
                break
            j = state[:n] | data[at[:n] + k]
            got[:n] += self.flat_took[j]
            state[:n] = self.flat_next[j] << 8
        last = self.end[state >> 8]
        total[by_size] = np.where(last == FAIL, 1, got + last)
        return total


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of every word, and for each text the number of words before it (n + 1 numbers)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_BLANK[data]
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    # A word ends with its text even if the next one begins without a blank.
    inside = offsets[1:-1]
    inside = inside[(inside > 0) & (inside < len(data))]
    first[inside] |= solid[1:-1][inside]
    last[inside - 1] |= solid[1:-1][inside - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops - starts, np.searchsorted(starts, offsets)


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        if vocabulary_path not in _AUTOMATA:
            _AUTOMATA[vocabulary_path] = LongestMatch(vocabulary(vocabulary_path))
        automaton = _AUTOMATA[vocabulary_path]
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets, 4_000_000):
                own = offsets[lo : hi + 1] - offsets[lo]
                part = data[offsets[lo] : offsets[hi]]
                starts, sizes, first = words_of(part, own)
                sums = np.append(0, np.cumsum(automaton.count(part, starts, sizes)))
                yield batch(schema, b.column(0).slice(lo, hi - lo), np.diff(first), np.diff(sums[first]))

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
