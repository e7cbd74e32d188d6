"""A Burkhard-Keller tree over 64-bit fingerprints, built and searched a level at a time with numpy."""

from __future__ import annotations

import numpy as np


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent. Equal keys may repeat: a repeat is a child at
    distance 0."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.keys = keys = np.asarray(keys, np.uint64)
        codes, nodes = [], []
        member = np.arange(1, n)
        parent = np.zeros(n - 1 if n else 0, np.int64)
        while len(member):
            d = np.bitwise_count(keys[member] ^ keys[parent]).astype(np.int64)
            code = parent * 128 + d
            order = np.argsort(code, kind="stable")
            member, code = member[order], code[order]
            first = np.r_[True, code[1:] != code[:-1]]
            codes.append(code[first])
            nodes.append(member[first])
            group = np.cumsum(first) - 1
            parent = member[first][group][~first]
            member = member[~first]
        code = np.concatenate(codes) if codes else np.empty(0, np.int64)
        node = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        order = np.argsort(code)
        self.edge, self.child = code[order], node[order]

    def within(self, queries: np.ndarray, radius: int, block: int = 1024):
        """Yield (query positions, key positions) of all pairs at most radius apart, a block of queries at a time."""
        if not len(self.keys):
            return
        for at in range(0, len(queries), block):
            own = np.asarray(queries[at : at + block], np.uint64)
            q, k = np.arange(len(own)), np.zeros(len(own), np.int64)
            found = []
            while len(q):
                d = np.bitwise_count(own[q] ^ self.keys[k]).astype(np.int64)
                hit = d <= radius
                found.append((q[hit], k[hit]))
                lo = np.searchsorted(self.edge, k * 128 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.edge, k * 128 + np.minimum(d + radius, 127), side="right")
                n = hi - lo
                q = np.repeat(q, n)
                k = self.child[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(q))]
            yield np.concatenate([x for x, _ in found]) + at, np.concatenate([x for _, x in found])


class Forest:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Many unions at once: hook roots to smaller roots and halve paths until nothing moves."""
        while len(a):
            self.flatten()
            a, b = self.up[a], self.up[b]
            go = a != b
            a, b = a[go], b[go]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def flatten(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up
