"""Plain versions of the operators, to hold the distributed ones against."""

import hashlib
import re

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(n, linked):
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, size):
    words = WORD.findall(lower(text))
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def simhash(text, size=3):
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(text, size)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def simhash_rows(docs, size=3, radius=2):
    """docs: (doc_id, text). Rows as the operator's."""
    f = [simhash(t, size) for _, t in docs]
    root = components(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= radius])
    least = {}
    for r, (i, _) in zip(root, docs):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{x:016x}", least.get(r)) for r, x, (i, _) in zip(root, f, docs)]


def near_rows(docs, size=5, similarity=0.8):
    sets = [frozenset(shingles(t, size)) for _, t in docs]
    own = [i for i, s in enumerate(sets) if s]
    linked = [(i, j) for i in own for j in own if j < i and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    root = components(len(docs), linked)
    least = {}
    for r, (i, _) in zip(root, docs):
        least[r] = min(i, least.get(r, i))
    return [(docs[i][0], least[root[i]]) for i in own]


def contamination_rows(docs, bench, span=8):
    windows = {}
    for item, text in bench:
        w = BENCH_WORD.findall(lower(text))
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    rows = []
    for doc, text in docs:
        w = BENCH_WORD.findall(lower(text))
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        rows.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2))
    return rows
