"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

The network is trained in numpy on a bounded sample of labelled documents and scores all overlapping windows of every
whole text. A text is as toxic as its worst window; a logistic curve, fitted on the sample, makes that a probability.
Labels are of texts, not of windows: of a toxic text the window that its words' log-odds point at is learnt from first,
and later the one that the network itself scores highest; of other texts also windows at random. The first number of each
embedding starts as the log-odds of the label given the word, or the character n-gram, within a text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm._common import by_pieces
from tabloom.llm.decontaminate import words_of

#: Words of a window, words from one window to the next, cells of each direction, width of an embedding.
WINDOW, STRIDE, CELLS, WIDTH = 32, 16, 8, 8
#: Parts of the sample; what a text's words say about the label comes from the other parts.
FOLDS = 4
#: Buckets of character n-grams and their lengths in bytes; windows that run at once; words that a worker remembers.
GRAMS, LENGTHS, BATCH, REMEMBERED = 16_384, (3, 5, 7), 2048, 60_000
#: Texts that a worker takes from Arrow at once, words that it scores at once and windows of a stretch of a long text.
ROWS, WORDS, STRETCH = 256, 25_000, 512


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _grams_of(word: bytes) -> list[int]:
    w = b"^" + word + b"$"
    return [zlib.crc32(w[i : i + n]) % GRAMS for n in LENGTHS for i in range(max(1, len(w) - n + 1))]


def _scattered(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n rows: at each place the sum of the rows that go there."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[at[order][first]] = np.add.reduceat(rows[order], first)
    return out


def _odds(yes: np.ndarray, no: np.ndarray, share: float, prior: float = 4.0) -> np.ndarray:
    """Log-odds of the label given that a text has something, drawn to the label's share where it is rare."""
    return np.log((yes + prior * share) / (no + prior * (1 - share))) - np.log(share / (1 - share))


def _flat_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' grams one after another, and how many each has."""
    counts = np.empty(len(words), np.int32)
    parts = []
    for lo in range(0, len(words), 4096):
        own = [_grams_of(w) for w in words[lo : lo + 4096]]
        counts[lo : lo + len(own)] = [len(g) for g in own]
        parts.append(np.array([x for g in own for x in g], np.int32))
    return np.concatenate(parts) if parts else np.empty(0, np.int32), counts


class Lexicon:
    """Distinct words by number, with their grams."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.flat, self.counts = _flat_grams(words)
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.counts[ids].astype(np.int64)
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.flat[at], n


def windows_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text's word ids (rows; -1 where a text is over) and their lengths: every STRIDE words one begins,
    until one reaches the end."""
    n = len(ids)
    if not n:
        return np.empty((0, WINDOW), np.int64), np.empty(0, np.int64)
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    starts = starts[(starts == 0) | (starts < n - WINDOW + STRIDE)]
    padded = np.r_[ids, np.full(WINDOW + STRIDE, -1)]
    return padded[starts[:, None] + np.arange(WINDOW)], np.minimum(n - starts, WINDOW)


class Network:
    """Parameters: word and gram embeddings, and of either direction input weights, recurrent weights and a bias; then
    the attention's vector, the output's weights and bias."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 0):
        r = np.random.default_rng(seed)
        normal = lambda *s, scale=0.3: r.normal(0, scale, s).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": normal(len(vocabulary) + 1, WIDTH, scale=0.1), "gram": normal(GRAMS, WIDTH, scale=0.1)}
        for d in "fb":
            self.p |= {f"w{d}": normal(2 * WIDTH, 3 * CELLS), f"u{d}": normal(CELLS, 3 * CELLS), f"b{d}": np.zeros(3 * CELLS, np.float32)}
        self.p |= {"att": normal(2 * CELLS), "out": normal(2 * CELLS), "bias": np.zeros(1, np.float32)}
        self.curve = (1.0, 0.0)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Of each word its row among the embeddings, 0 for unknown ones."""
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int64)

    def inputs(self, rows: np.ndarray, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each word the embedding in its row beside those of its grams, summed and divided by the root of their number."""
        sums = np.add.reduceat(self.p["gram"][flat], np.cumsum(n, dtype=np.int64) - n)
        return np.concatenate([self.p["word"][rows], sums / np.sqrt(n)[:, None]], 1).astype(np.float32)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb"}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (time, batch, cells) of one direction over x (time, batch, 3 cells); where mask is 0 a state stays."""
        u, c = self.p[f"u{d}"], CELLS
        h = np.zeros((x.shape[1], c), np.float32)
        out = np.empty((*x.shape[:2], c), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = h @ u
            zr = _sigmoid(x[t, :, : 2 * c] + g[:, : 2 * c])
            z, r = zr[:, :c], zr[:, c:]
            n = np.tanh(x[t, :, 2 * c :] + r * g[:, 2 * c :])
            step = mask[t][:, None] * (1 - z)
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * c :]))
            h = h + step * (n - h)
            out[t] = h
        return out

    def logits(self, proj: dict[str, np.ndarray], at: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Of windows: at are rows of proj (-1 past the end)."""
        mask = (np.arange(at.shape[1])[:, None] < length).astype(np.float32)
        turned = np.maximum(at.T, 0)
        traces = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([self._run(d, proj[d][turned], mask, traces[d]) for d in "fb"], 2)
        e = np.where(mask > 0, h @ self.p["att"], -1e9)
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        pooled = (a[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"mask": mask, "h": h, "a": a, "pooled": pooled, **traces}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, rows: np.ndarray, flat: np.ndarray, counts: np.ndarray, at: np.ndarray, length: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over windows of the words that rows, flat and counts describe."""
        x = self.inputs(rows, flat, counts)
        k: dict = {}
        p, c, proj = self.p, CELLS, self.projected(x)
        miss = ((_sigmoid(self.logits(proj, at, length, k)) - labels) / len(labels)).astype(np.float32)
        g = {"out": k["pooled"].T @ miss, "bias": miss.sum(keepdims=True)}
        pooled = miss[:, None] * p["out"]
        share = (k["h"] * pooled).sum(2)
        score = k["a"] * (share - (k["a"] * share).sum(0))
        g["att"] = (score[:, :, None] * k["h"]).sum((0, 1))
        states = k["a"][:, :, None] * pooled + score[:, :, None] * p["att"]
        dx, turned = np.zeros_like(x), np.maximum(at.T, 0)
        for i, d in enumerate("fb"):
            u, own = p[f"u{d}"], states[:, :, i * c : (i + 1) * c]
            gu, moved, back = np.zeros_like(u), np.zeros((*turned.shape, 3 * c), np.float32), 0
            for t, h, z, r, n, gn in reversed(k[d]):
                dh = own[t] + back
                step = k["mask"][t][:, None] * dh
                dn = step * (1 - z) * (1 - n * n)
                dz = step * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                into = np.concatenate([dz, dr, dn], 1)
                gate = np.concatenate([dz, dr, dn * r], 1)
                gu += h.T @ gate
                moved[t] = into
                back = dh - step * (1 - z) + gate @ u.T
            gp = _scattered(moved.reshape(-1, 3 * c), turned.ravel(), len(x))
            g[f"u{d}"], g[f"w{d}"], g[f"b{d}"] = gu, x.T @ gp, gp.sum(0)
            dx += gp @ p[f"w{d}"].T
        g["word"] = _scattered(dx[:, :WIDTH], rows, len(p["word"]))
        g["gram"] = _scattered(np.repeat(dx[:, WIDTH:] / np.sqrt(counts)[:, None], counts, 0), flat, GRAMS)
        return g

    def worst(self, texts: list[np.ndarray], lexicon: Lexicon, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest logit of each text's windows and the window's number. texts are word numbers; rows are the words'."""
        best, which = np.empty(len(texts)), np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            kinds, ids = np.unique(text, return_inverse=True)
            scores = self.run(self.projected(self.inputs(rows[kinds], *lexicon.grams(kinds))), *windows_of(ids))
            which[i] = int(np.argmax(scores))
            best[i] = scores[which[i]]
        return best, which

    def run(self, proj: dict[str, np.ndarray], at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.concatenate([self.logits(proj, at[i : i + BATCH], length[i : i + BATCH]) for i in range(0, len(at), BATCH)])

    def probability(self, logit: np.ndarray) -> np.ndarray:
        """Of a text by its worst window; 0 without words."""
        a, b = self.curve
        return np.where(np.isfinite(logit), _sigmoid(a * np.where(np.isfinite(logit), logit, 0) + b), 0.0)


class Constant:
    """Where the sample has no or one label only."""

    def __init__(self, share: float):
        self.share = share

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return np.full(len(logit), self.share)


def fit(sample: list[tuple[bytes, int]], totals: tuple[int, int] | None = None, steps: int = 300, size: int = 128, rate: float = 0.01, decay: float = 1e-4, ripe: int = 300, unknown: float = 0.5, most_words: int = 8000, checked: int = 100, seed: int = 0):
    """A network from (text, label) rows. Every fifth row of either label is kept back for the logistic curve; in each
    step a share `unknown` of the known words is taken as unknown, so that the network learns from characters too. What
    words say about the label is counted over other parts of the sample than the text's own, so that the network does
    not trust what only its own texts have; with fewer than `ripe` toxic texts embeddings learn the slower. Up to
    `checked` texts of either label and part are scored so for the curve, beside those kept back.
    totals are the rows of either label that the sample stands for: the curve weighs its rows accordingly."""
    numbers: dict[bytes, int] = {}
    texts, labels = [], []
    for t, y in sample:
        if words := words_of(t):
            texts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32))
            labels.append(y)
    labels = np.array(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return Constant(float(labels[0]) if len(labels) else 0.0)
    lexicon = Lexicon(list(numbers))
    del numbers
    back = np.zeros(len(texts), bool)
    for y in (0, 1):
        back[np.flatnonzero(labels == y)[4::5]] = True
    spare, spared = [texts[i] for i in np.flatnonzero(back)], labels[back]
    texts, labels = [texts[i] for i in np.flatnonzero(~back)], labels[~back]
    share = float(labels.mean())
    fold = np.empty(len(texts), np.int64)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        fold[own] = np.arange(len(own)) % FOLDS
    seen, gram_seen = np.zeros((FOLDS, 2, len(lexicon.words))), np.zeros((FOLDS, 2, GRAMS))
    for t, y, k in zip(texts, labels, fold, strict=True):
        own = np.unique(t)
        seen[k, int(y), own] += 1
        gram_seen[k, int(y), np.unique(lexicon.grams(own)[0])] += 1
    total = seen.sum((0, 1))
    common = np.flatnonzero(total >= 3)
    common = common[np.argsort(-total[common], kind="stable")][:most_words]
    net, r = Network({lexicon.words[i]: k + 1 for k, i in enumerate(common)}, seed), np.random.default_rng(seed)
    seen = seen[:, :, common]

    def point(without: int | None) -> None:
        """Set the first number of each embedding from all folds but one."""
        for name, counts, at in (("word", seen, 1), ("gram", gram_seen, 0)):
            own = counts.sum(0) - (0 if without is None else counts[without])
            net.p[name][at:, 0] = _odds(own[1], own[0], share)

    rows = np.zeros(len(lexicon.words), np.int64)
    rows[common] = np.arange(1, len(common) + 1)
    pointed = [0] * len(texts)
    for k in range(FOLDS):
        point(k)
        value = np.add.reduceat(net.p["gram"][lexicon.flat, 0], lexicon.starts) / np.sqrt(lexicon.counts)
        for i in np.flatnonzero(fold == k):
            pointed[i] = _top_window(value[texts[i]])
    of = [[np.flatnonzero((labels == y) & (fold == k)) for y in (1, 0)] for k in range(FOLDS)]
    of = {k: x for k, x in enumerate(of) if all(map(len, x))}
    toxic = np.flatnonzero(labels == 1)
    m = {n: np.zeros_like(v) for n, v in net.p.items()}
    v = {n: np.zeros_like(x) for n, x in net.p.items()}
    for step in range(1, steps + 1):
        k = list(of)[step % len(of)] if of else None
        point(k)
        yes, no = of[k] if of else (np.flatnonzero(labels == 1), np.flatnonzero(labels == 0))
        if step == steps // 2:
            pointed = net.worst(texts, lexicon, rows)[1].tolist()
        own = np.r_[r.choice(yes, size // 2), r.choice(no, size // 2)]
        at, length = np.full((size, WINDOW), -1), np.zeros(size, np.int64)
        for j, i in enumerate(own):
            last = max(1, len(range(0, max(1, len(texts[i]) - WINDOW + STRIDE), STRIDE)))
            w = pointed[i] if labels[i] or r.random() < 0.5 else int(r.integers(0, last))
            words = texts[i][w * STRIDE : w * STRIDE + WINDOW]
            length[j] = len(words)
            at[j, : len(words)] = words
        kinds, turned = np.unique(at, return_inverse=True)
        past = int(kinds[0] == -1)
        kinds, at = kinds[past:], turned.reshape(at.shape) - past
        hidden = np.where(r.random(len(kinds)) < unknown, 0, rows[kinds])
        grads = net.gradients(hidden, *lexicon.grams(kinds), at, length, labels[own])
        for name, g in grads.items():
            g = g + decay * net.p[name]
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.99 * v[name] + 0.01 * g * g
            pace = rate * (min(1.0, len(toxic) / ripe) if name in ("word", "gram") else 1)
            net.p[name] -= pace * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    logits, seen_by = [], []
    for k in range(FOLDS):  # what the sample would score by other parts' words, known words taken as unknown
        point(k)
        own = np.concatenate([np.flatnonzero((fold == k) & (labels == y))[:checked] for y in (0, 1)])
        logits.append(net.worst([texts[i] for i in own], lexicon, np.zeros_like(rows))[0])
        seen_by.append(labels[own])
    point(None)
    logits, y = np.concatenate([*logits, net.worst(spare, lexicon, rows)[0]]), np.concatenate([*seen_by, spared])
    own = np.array([(y == k).sum() for k in (0, 1)])
    net.curve = _curve(logits, y, (np.array(totals or [(labels == k).sum() + (spared == k).sum() for k in (0, 1)]) / own)[y.astype(int)])
    return net


def _top_window(odds: np.ndarray) -> int:
    best = int(np.argmax(odds))
    last = max(0, -(-(len(odds) - WINDOW) // STRIDE))
    return min(last, max(0, (best - WINDOW // 2) // STRIDE))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one number, by Newton's method with a little damping."""
    a, b = 1.0, 0.0
    x = x.astype(np.float64)
    weight = weight / weight.mean()
    for _ in range(rounds):
        p = _sigmoid(a * x + b)
        w, miss = weight * p * (1 - p) + 1e-6, weight * (p - y)
        ga, gb = (miss * x).sum() + 1e-3 * (a - 1), miss.sum()
        haa, hab, hbb = (w * x * x).sum() + 1e-3, (w * x).sum(), w.sum()
        det = haa * hbb - hab * hab + 1e-9
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return max(float(a), 1e-3), float(b)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 2000, most_bytes: int = 32_768):
    """A network from at most `most` documents of either label, of at most most_bytes each, chosen by a hash of their
    ids among those that are not held out. Rows with a null id or label, and labels other than 0 and 1, don't count; of
    several labels of one id the highest does."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    mixed = F.xxhash64("doc_id")
    ids = [r for y in (0, 1) for r in marked.where(F.col("toxic") == y).orderBy(mixed, "doc_id").limit(most).collect()]
    if not ids:
        return Constant(0.0)
    chosen = docs.sparkSession.createDataFrame(ids, marked.schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    # of repeated ids one row: the table holds `most` ids of each label, which bounds what is broadcast and collected
    sample = texts.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= most_bytes).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    return fit([(bytes(r["text"]), r["toxic"]) for r in sorted(sample.collect())], (found.get(0, 0), found.get(1, 0)))


def toxicity(docs: DataFrame, model, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `cut` on), a row per row of docs. Only the text makes the score; a
    null text is empty, and a text without words scores 0 (without a sample, the one label's share). Null ids are kept
    and not held out; repeated rows score alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for b in batches:
            s = np.concatenate([score(b.column(2).slice(lo, ROWS).to_pylist()) for lo in range(0, max(1, b.num_rows), ROWS)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model, cut: float = 0.7) -> DataFrame:
    """The rows of docs, all their columns, whose text scores less than `cut`."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        return by_pieces(batches, lambda b: b.filter(pa.array(score([(t or "").encode() for t in b.column(at).to_pylist()]) < cut)), ROWS)

    return docs.mapInArrow(run, docs.schema)


class Scorer:
    """Scores texts in a worker. Inputs of words are remembered, as many as REMEMBERED at most."""

    def __init__(self, model):
        self.model, self.kinds = model, {}
        self.proj = {d: np.empty((0, 3 * CELLS), np.float32) for d in "fb"}

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        if not isinstance(self.model, Constant):
            waiting, size = [], 0
            for i, t in enumerate(texts):
                words = words_of(t)
                for lo in range(0, max(min(len(words), 1), len(words) - WINDOW + STRIDE), STRIDE * STRETCH):  # a long text comes in stretches that share a window
                    waiting.append((i, words[lo : lo + STRIDE * STRETCH + WINDOW - STRIDE]))
                    size += len(waiting[-1][1])
                    if size >= WORDS:
                        self._score(waiting, best)
                        waiting, size = [], 0
            self._score(waiting, best)
        return self.model.probability(best)

    def _score(self, waiting: list[tuple[int, list[bytes]]], best: np.ndarray) -> None:
        if not waiting:
            return
        if len(self.kinds) > REMEMBERED:
            self.kinds, self.proj = {}, {d: p[:0] for d, p in self.proj.items()}
        known, kinds = len(self.kinds), self.kinds
        parts = [windows_of(np.array([kinds.setdefault(w, len(kinds)) for w in words], np.int64)) for _, words in waiting]
        if len(kinds) > known:
            words = list(islice(kinds, known, None))
            fresh = self.model.projected(self.model.inputs(self.model.rows(words), *_flat_grams(words)))
            self.proj = {d: np.concatenate([self.proj[d], fresh[d]]) for d in "fb"}
        owner = np.repeat([i for i, _ in waiting], [len(w) for w, _ in parts])
        scores = self.model.run(self.proj, np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts]))
        np.maximum.at(best, owner, scores)
