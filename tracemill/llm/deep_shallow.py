"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, then blind tries.

Suffixes count up to a fixed depth: two that agree so far are equal. Groups that agree on the shallow depth have a
long common prefix, so the deep step compares each new suffix with one other only, found by a blind descent.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24  # bytes, in keys of eight


def _keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that sorts as the bytes do."""
    return data[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)


class BlindTrie:
    """A trie that keeps only branching bytes. Inserting looks at branching bytes on the way down, compares the
    suffix with the one leaf it arrives at, and branches where the two first differ."""

    def __init__(self, suffix: bytes, item: int):
        self.root: list = [None, suffix, [item]]  # [depth or None, suffix | children, items]

    def insert(self, suffix: bytes, item: int) -> None:
        node = self.root
        while node[0] is not None:
            child = node[1].get(suffix[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = node[1]
        if suffix == other:
            node[2].append(item)
            return
        a, b = int.from_bytes(suffix, "big"), int.from_bytes(other, "big")
        depth = len(suffix) - 1 - ((a ^ b).bit_length() - 1) // 8
        node = self.root
        while node[0] is not None and node[0] < depth:
            node = node[1][suffix[node[0]]]
        if node[0] == depth:
            node[1][suffix[depth]] = [None, suffix, [item]]
        else:
            node[:] = [depth, {other[depth]: node[:], suffix[depth]: [None, suffix, [item]]}, None]

    def leaves(self):
        """Items of equal suffixes, in the suffixes' order."""
        stack = [self.root]
        while stack:
            depth, inner, items = stack.pop()
            if depth is None:
                yield items
            else:
                stack += [inner[b] for b in sorted(inner, reverse=True)]


def sort_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[a : a + depth] within each group, and which of them equal the one before.

    ``depth`` is above SHALLOW, and every suffix has as many bytes in ``data``.
    """
    n = len(at)
    order = np.argsort(group, kind="stable")
    cls = np.zeros(n, np.int64)  # class of each place of the order: suffixes not told apart yet
    same = np.zeros(n, bool)
    same[1:] = group[order[1:]] == group[order[:-1]]
    for d in range(0, SHALLOW, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order, np.zeros(n, bool)
        cls[rows] = np.cumsum(~same[rows])
        keys = _keys(data, at[order[rows]] + d)
        by = np.lexsort((keys, cls[rows]))
        order[rows], keys = order[rows][by], keys[by]
        c = cls[rows]
        same[rows[1:]] = (c[1:] == c[:-1]) & (keys[1:] == keys[:-1])
        same[rows[0]] = False
    equal = np.zeros(n, bool)
    first = np.flatnonzero(~same & np.append(same[1:], False))
    stop = np.flatnonzero(same & ~np.append(same[1:], False)) + 1
    rest = np.arange(SHALLOW, depth)
    two = first[stop - first == 2]
    for lo in range(0, len(two), 100_000):
        # A trie of two suffixes is one comparison.
        p = two[lo : lo + 100_000]
        a, b = data[at[order[p]][:, None] + rest], data[at[order[p + 1]][:, None] + rest]
        differ = a != b
        where = differ.argmax(1)
        rows = np.arange(len(p))
        equal[p + 1] = ~differ[rows, where]
        swap = a[rows, where] > b[rows, where]
        order[p[swap]], order[p[swap] + 1] = order[p[swap] + 1], order[p[swap]].copy()
    many = stop - first > 2
    raw = data.tobytes()
    for lo, hi in zip(first[many].tolist(), stop[many].tolist(), strict=True):
        items = order[lo:hi].tolist()
        places = at[order[lo:hi]].tolist()
        trie = BlindTrie(raw[places[0] + SHALLOW : places[0] + depth], items[0])
        for i, p in zip(items[1:], places[1:], strict=True):
            trie.insert(raw[p + SHALLOW : p + depth], i)
        k = lo
        for leaf in trie.leaves():
            order[k : k + len(leaf)] = leaf
            equal[k + 1 : k + len(leaf)] = True
            k += len(leaf)
    return order, equal
