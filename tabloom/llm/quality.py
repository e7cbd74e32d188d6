"""A quality classifier by co-training: one view of a text's content, one of a document's metadata.

Both are logistic regressions. Content is hashed words and pairs of words beside shares of kinds of characters; metadata
are language, source and length. Features of whole texts are made once and kept as a table. Over rounds each view scores
all unlabelled documents, and labels those of which it is most sure for the other; then each view is calibrated on
labelled documents kept back, and the calibrated views are combined. Only bounded samples of features come to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm._common import small, stored
from tabloom.llm.ngram_lm import MIX, U, _mixed, _parts, tokens

#: Buckets of the hashed words, of the pairs, and of each of the metadata's hashed values.
WORDS, PAIRS, BUCKETS = 512, 512, 32
#: Kinds of ASCII characters whose shares count, as (characters, factor).
KINDS = ((b"*#$%&", 10), (b"|", 10), (b"!", 10), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), (b"0123456789", 10), (b"\n", 10), (b".", 10))
DENSE = len(KINDS) + 3


def _kinds() -> np.ndarray:
    of = np.full(256, len(KINDS))
    for k, (chars, _) in enumerate(KINDS):
        of[list(chars)] = k
    return of


def text_features(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of binary texts: dense numbers (shares of KINDS, immediate repeats, letters a word, logarithm of words), and the
    buckets of their words and pairs with their counts."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    size = np.diff(offsets)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None and size.sum() else np.empty(0, np.uint8)
    width = len(KINDS) + 1
    counts = np.bincount(np.repeat(np.arange(n), size) * width + _kinds()[data], minlength=n * width).reshape(n, width)[:, :-1]
    shares = counts * np.array([f for _, f in KINDS]) / np.maximum(size, 1)[:, None]
    words, per = tokens(texts)
    own = np.repeat(np.arange(n), per)
    last = np.cumsum(per) - 1
    inner = np.ones(len(words), bool)
    inner[last] = False
    second = inner.copy()
    second[np.r_[0, last[:-1] + 1]] = False
    before = np.r_[U(0), words[:-1]]
    repeats = np.bincount(own[second & (words == before)], minlength=n)
    many = np.maximum(per - 1, 1)
    dense = np.c_[shares, repeats / many, size / many / 6, np.log1p(per - 1) / 5].astype(np.float32)
    pairs = _mixed(before * MIX ^ words) % U(PAIRS) + U(WORDS)
    key = np.r_[own[inner] * (WORDS + PAIRS) + (words[inner] % U(WORDS)).astype(np.int64), own[second] * (WORDS + PAIRS) + pairs[second].astype(np.int64)]
    key, count = np.unique(key, return_counts=True)
    cut = np.searchsorted(key, np.arange(1, n) * (WORDS + PAIRS))
    return dense, np.split(key % (WORDS + PAIRS), cut), np.split(count, cut)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, t (dense), b and c (buckets and counts) and m (metadata: buckets of language and source, each null a value
    of its own, and the logarithm of the length twice over), a row per row of docs. Absent columns count as null."""
    of = lambda c: F.col(c) if c in docs.columns else F.lit(None)
    hashed = lambda c, k: (F.pmod(F.xxhash64(F.lit(c), F.coalesce(of(c).cast("string"), F.lit(""))), F.lit(BUCKETS)) + BUCKETS * k).cast("float")
    size = F.log1p(F.coalesce(F.greatest(of("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))).cast("float") / 8
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(hashed("lang", 0), hashed("source", 1), size.cast("float")).alias("m"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dense, buckets, counts = [], [], []
            for part in _parts(b.column(2)):
                d, k, c = text_features(part)
                dense += d.tolist()
                buckets += k
                counts += c
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dense, pa.list_(pa.float32())), pa.array(buckets, pa.list_(pa.int16())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "m", "t", "b", "c"])

    return own.mapInArrow(run, "doc_id long, m array<float>, t array<float>, b array<short>, c array<int>")


def _text_view(t: pa.Array, b: pa.Array, c: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense numbers; and of the others rows, buckets and values: roots of the shares of words and pairs."""
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(b.offsets.to_numpy())
    row, count = np.repeat(np.arange(len(b)), n), flat(c).astype(np.float64)
    total = np.maximum(np.bincount(row, count, len(b)), 1)
    return flat(t).reshape(len(t), DENSE).astype(np.float64), row, flat(b).astype(np.int64), 2 * np.sqrt(count / total[row])


def _meta_view(m: pa.Array) -> np.ndarray:
    lang, source, size = m.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3).astype(np.float64).T
    out = np.zeros((len(lang), 2 * BUCKETS + 2))
    out[np.arange(len(out)), lang.astype(int)] = 1
    out[np.arange(len(out)), source.astype(int)] = 1
    out[:, -2], out[:, -1] = size, size * size
    return out


def _matrix(view: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    dense, row, bucket, value = view
    out = np.zeros((len(dense), DENSE + WORDS + PAIRS), np.float32)
    out[:, :DENSE] = dense
    out[row, DENSE + bucket] = value
    return out


def _text_value(w: np.ndarray, view: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    dense, row, bucket, value = view
    return dense @ w[:DENSE] + np.bincount(row, w[DENSE + bucket] * value, len(dense)) + w[-1]


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 20) -> np.ndarray:
    """Weights and a bias last, by Newton's method; each step is solved by conjugate gradients."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    w = np.zeros(x.shape[1])
    keep = np.r_[np.full(len(w) - 1, ridge), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = weight * p * (1 - p) + 1e-9
        rest = -(x.T @ (weight * (p - y)) + keep * w)
        move, ahead, size = np.zeros_like(w), rest.copy(), rest @ rest
        for _ in range(60):
            if size < 1e-14:
                break
            turned = x.T @ (curve * (x @ ahead)) + keep * ahead
            step = size / (ahead @ turned)
            move += step * ahead
            rest = rest - step * turned
            size, old = rest @ rest, size
            ahead = rest + size / old * ahead
        w += move
        if abs(move).max() < 1e-6:
            break
    return w


def _value(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class CoTraining:
    """Labelled rows of two views, of which every fourth is kept for calibration, and the pseudo-labelled rows that each
    view has got from the other; those weigh half."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray):
        back = np.zeros(len(y), bool)
        for label in (0, 1):
            back[np.flatnonzero(y == label)[3::4]] = True
        if len(set(y[back].tolist())) < 2:
            back[:] = False
        self.views, self.y, self.own, self.test = views, y, ~back, back if back.any() else ~back
        self.more: list[list[tuple[np.ndarray, float]]] = [[], []]
        self.refit()

    def refit(self) -> None:
        self.weights = []
        for v, more in zip(self.views, self.more, strict=True):
            x = np.concatenate([v[self.own], *[r[None] for r, _ in more]]) if more else v[self.own]
            y, n = np.r_[self.y[self.own], [label for _, label in more]], self.own.sum()
            self.weights.append(_fit(x, y, np.r_[np.ones(n), np.full(len(more), 0.5)]))

    def combined(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Calibrated weights of each view on raw features, and the combination's weights on both and its bias."""
        curves, y = [], self.y[self.test]
        for v, w in zip(self.views, self.weights, strict=True):
            c = _fit(_value(w, v[self.test])[:, None], y, np.ones(len(y)), ridge=1e-2)
            curves.append(np.array([max(c[0], 0.0), c[1]]))
        both = np.stack([_value(w, v[self.test]) * c[0] + c[1] for v, w, c in zip(self.views, self.weights, curves, strict=True)], 1)
        joint = _fit(both, y, np.ones(len(y)), ridge=1e-1)
        return [np.r_[w[:-1] * c[0], w[-1] * c[0] + c[1]] for w, c in zip(self.weights, curves, strict=True)], joint


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _surest(free: DataFrame, weights: list[np.ndarray], given: set[tuple[int, int]], most: int, sure: float) -> list[tuple[int, int, int]]:
    """(view, label, id): of all rows of free, the `most` of either label of which each view is the surest, `sure` at
    least, and that it has not given before. A task passes on so many rows at most, without features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[float, int]]] = {(v, y): [] for v in (0, 1) for y in (0, 1)}
        for b in batches:
            ids = b.column(0).to_numpy()
            for v, z in enumerate((_text_value(weights[0], _text_view(b.column(1), b.column(2), b.column(3))), _value(weights[1], _meta_view(b.column(4))))):
                for y in (0, 1):
                    q = 1 / (1 + np.exp(-np.clip(z if y else -z, -30, 30)))
                    at = [i for i in np.flatnonzero(q >= sure).tolist() if (v, int(ids[i])) not in given]
                    own = {i: p for p, i in best[v, y]} | {int(ids[i]): float(q[i]) for i in at}
                    best[v, y] = sorted(((p, i) for i, p in own.items()), key=lambda x: (-round(x[0], 9), _order(x[1])))[:most]
        rows = [(v, y, p, _order(i), i) for (v, y), own in best.items() for p, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()))], ["view", "label", "p", "mixed", "id"])

    tops = stored(free.select("doc_id", "t", "b", "c", "m").mapInArrow(run, "view int, label int, p double, mixed long, id long"), "quality-surest")
    out = []
    for v in (0, 1):
        for y in (0, 1):
            own = tops.where((F.col("view") == v) & (F.col("label") == y)).groupBy("id").agg(F.max(F.round("p", 9)).alias("p"), F.first("mixed").alias("mixed"))
            out += [(v, y, r["id"]) for r in own.orderBy(F.desc("p"), "mixed", "id").limit(most).collect()]
    return out


def _order(i: int) -> int:
    return int(_mixed(np.array([i & 0xFFFFFFFFFFFFFFFF], U))[0] >> U(1))


def _fetched(table: DataFrame, ids: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of both views of a bounded list of ids; of several rows of an id one."""
    chosen = F.broadcast(table.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
    rows = table.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("t", "b", "c", "m")).alias("x")).select("doc_id", "x.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return {}
    col = lambda name, t: pa.array([r[name] for r in rows], pa.list_(t))
    text = _matrix(_text_view(col("t", pa.float32()), col("b", pa.int16()), col("c", pa.int32())))
    return {r["doc_id"]: (a, b) for r, a, b in zip(rows, text, _meta_view(col("m", pa.float32())), strict=True)}


def train(table: DataFrame, labels: DataFrame, most: int = 2000, rounds: int = 3, give: int = 100, sure: float = 0.95):
    """CoTraining.combined() from a stored table of features; None where there is not some of either label.

    The fit takes `most` documents of either label at most, chosen by a hash of their ids among those that are not held
    out. In each round each view scores all documents without a label and outside of the held-out part, and gives the
    other the `give` of either label of which it is the surest. Rows with a null id or label don't count; of several
    labels of one id the lowest does, of several documents one."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    usable = table.where(F.col("doc_id").isNotNull() & ~held_out())
    marked = stored(marked.where(~held_out()), "quality-labels")
    chosen = {r["doc_id"]: y for y in (0, 1) for r in marked.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}
    if len(set(chosen.values())) < 2:
        return None
    got = _fetched(usable, list(chosen))
    ids = sorted(got, key=lambda i: (_order(i), i))
    y = np.array([float(chosen[i]) for i in ids])
    if len(set(y.tolist())) < 2:
        return None
    state = CoTraining([np.stack([got[i][v] for i in ids]) for v in (0, 1)], y)
    free = usable.join(small(marked.select("doc_id")), "doc_id", "left_anti")
    given: set[tuple[int, int]] = set()
    for _ in range(rounds):
        found = _surest(free, state.weights, given, give, sure)
        if not found:
            break
        rows = _fetched(usable, sorted({i for _, _, i in found}))
        for v, label, i in found:
            given.add((v, i))
            state.more[1 - v].append((rows[i][1 - v], float(label)))
        state.refit()
    return state.combined()


def quality(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **how) -> DataFrame:
    """doc_id, held_out, text_score, meta_score (calibrated views), score (both) and predicted (1 from `cut` on), a row
    per row of docs. Without a model every score is null and predicted is 1, so that nothing is lost for want of labels.

    Null texts are empty; absent or null metadata is a value of its own; null ids and repeated rows are scored like any
    other; an empty table gives an empty one. Other columns are not read, whatever their names."""
    table = stored(features(docs), "quality-features")
    return quality_scores(table, train(table, labels, **how), cut)


def quality_scores(table: DataFrame, model, cut: float = 0.5) -> DataFrame:
    """The scores of a table of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                scores = [pa.nulls(b.num_rows, pa.float64())] * 3
                sure = np.ones(b.num_rows, bool)
            else:
                (wt, wm), joint = model
                z = np.c_[_text_value(wt, _text_view(b.column(2), b.column(3), b.column(4))), _value(wm, _meta_view(b.column(5)))]
                p = 1 / (1 + np.exp(-np.clip(np.c_[z, z @ joint[:2] + joint[2]], -30, 30)))
                scores, sure = [pa.array(p[:, i]) for i in range(3)], p[:, 2] >= cut
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *scores, pa.array(sure.astype(np.int32))], ["doc_id", "held_out", "text_score", "meta_score", "score", "predicted"])

    own = table.select("doc_id", held_out().alias("held_out"), "t", "b", "c", "m")
    return own.mapInArrow(run, "doc_id long, held_out boolean, text_score double, meta_score double, score double, predicted int")
