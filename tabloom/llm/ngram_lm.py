"""An interpolated modified Kneser-Ney n-gram model (Chen and Goodman, 1999), counted in Spark.

Words are 48-bit hashes, n-grams pairs of a context's hash and a word's. Counting tasks sum what they read and deal the
sums out by context; the tasks that gather a range of contexts write its n-grams as sorted arrays of hashes and counts
to the shared folder and pass continuation counts on to the next lower order. Workers that score texts map those files
into memory and look n-grams up by binary search. No task and no file holds more than its range; nothing but counts of
counts and file names comes to the driver."""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from tabloom.llm._common import removed, shared_dir, stored

U = np.uint64
MIX, TURN = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Hashes of the end of a text and of what stands before its first word.
END, BEGIN = U(0x3593CC9E2D51), U(0xCA77C2B2AE63)
#: Bits of a word's hash: of a thousand million words a few thousand share theirs with another.
KEPT = U((1 << 48) - 1)
#: Tokens that a task counts or scores at a time; ranges of the model that a worker keeps open.
COUNTED, SCORED, MAPS = 3 << 20, 1 << 18, 4096


@lru_cache(None)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: a random number, and whether it is white space (20, 09 to 0D). A-Z have the numbers of a-z."""
    value = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    value[space] = 0
    return value, space


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * TURN
    return h ^ (h >> U(29))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of binary texts one after another, each text closed by END, and how many each text has."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    value, space = _bytes()
    gap = space[data]
    opens = ~gap
    opens[1:] &= gap[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[first] = ~gap[first]
    start = np.flatnonzero(opens)
    if len(start):
        at = np.arange(len(data)) - np.repeat(start, np.diff(np.r_[start, len(data)])) if not start[0] else np.arange(len(data)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(data)]))
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(int(at.max()) + 1, MIX))
            words = _mixed(np.add.reduceat(value[data] * power[at], start)) & KEPT
    else:
        words = np.empty(0, U)
    per = np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])
    out = np.empty(len(words) + n, U)
    ends = np.cumsum(per + 1) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = words
    out[ends] = END
    return out, per + 1


def contexts(words: np.ndarray, per: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the last 0, 1, ... order - 1 tokens before each token; BEGIN stands before a text's first ones."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(per) - per, per)
    out = [np.zeros(len(words), U)]
    for back in range(1, order):
        before = np.full(len(words), BEGIN)
        before[back:] = np.where(place[back:] >= back, words[:-back], BEGIN)
        out.append(_mixed(out[-1] * MIX + before))
    return out


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(context * MIX ^ word)


def _least_type(a: np.ndarray) -> np.ndarray:
    """a in the narrowest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(f"<u{n}" for n in (1, 2, 4, 8) if top < 1 << 8 * n), copy=False)


def _pack(arrays: list[np.ndarray], squeeze: bool) -> bytes:
    """Arrays one after another behind a header of widths, lengths and sizes; squeezed: like bytes side by side, then
    compressed, for what is moved and read whole; else as they are, each from a multiple of 8 on, to be mapped."""
    head, body = [len(arrays)], []
    for a in map(_least_type, arrays):
        data = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T if squeeze else a).tobytes()
        data = pa.compress(data, "zstd", asbytes=True) if squeeze and data else data + bytes(-len(data) % 8)
        head += [a.itemsize, len(a), len(data)]
        body.append(data)
    return b"".join([np.array(head, np.int64).tobytes(), *body])


def _unpack(blob, squeezed: bool) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at, out = 8 * (3 * n + 1), []
    for width, length, size in np.frombuffer(blob, np.int64, 3 * n, 8).reshape(n, 3).tolist():
        if squeezed and length:
            data = pa.decompress(memoryview(blob)[at : at + size], width * length, "zstd", asbytes=True)
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, length).T).view(f"<u{width}").ravel())
        else:
            out.append(np.frombuffer(blob, f"<u{width}", length, at))
        at += size
    return out


def _merged(ids: list[np.ndarray], kinds: int, sums: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Distinct rows of ids (each below kinds) in lexicographic order, how often each is there, and the sums of theirs."""
    bits, rows = max(1, (kinds - 1).bit_length()), len(ids[0])
    short = bits * len(ids) <= 64
    key = ids[0].astype(U)
    for x in ids[1:]:
        key = (key if short else np.unique(key, return_inverse=True)[1].astype(U)) << U(bits if short else 32) | x.astype(U)
    order = None if short and not sums else np.argsort(key)
    if order is None:
        key.sort()
    else:
        key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if rows else np.empty(0, np.int64)
    if order is None:
        key = key[new]
        ids = [(key >> U(bits * j) & U((1 << bits) - 1)).astype(x.dtype) for j, x in zip(range(len(ids) - 1, -1, -1), ids, strict=True)]
    else:
        ids = [x[order[new]] for x in ids]
    return ids, np.diff(new, append=rows).astype(U), [np.add.reduceat(x[order].astype(U), new) if rows else x[:0].astype(U) for x in sums]


def _by_range(deal: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their ranges, and where in it each range starts. Numbers of 16 bits sort the fastest."""
    shard = (deal % U(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    return np.argsort(shard, kind="stable"), np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]


def _context(words: list[np.ndarray]) -> np.ndarray:
    """The hash that contexts() gives, of columns of words, the oldest first."""
    out = np.zeros(len(words[0]), U)
    for w in reversed(words[:-1]):
        out = _mixed(out * MIX + w)
    return out


def _dealt(kinds: np.ndarray, ids: list[np.ndarray], counts: np.ndarray, raw: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, blob) of n-grams dealt out by context, or by word where there is none. kinds: hashes of words, sorted;
    ids: places in it, a column for each word. A blob has the words that it needs, and their places in those."""
    order, cut = _by_range(_context([kinds[x] for x in ids]) if len(ids) > 1 else kinds[ids[0]], shards)
    at = np.empty(len(kinds), np.uint32)
    for s in np.flatnonzero(np.diff(cut)).tolist():
        own = order[cut[s] : cut[s + 1]]
        part = [x[own] for x in ids]
        every = np.concatenate(part)
        at[every] = np.arange(len(every), dtype=np.uint32)
        used = np.sort(every[at[every] == np.arange(len(every))])  # of equal ones that which was written last
        at[used] = np.arange(len(used), dtype=np.uint32)
        part = [at[x] for x in part]
        n, r = counts[own], raw[own]
        yield s, _pack([np.diff(kinds[used], prepend=U(0)), *part, n, r[:0] if np.array_equal(n, r) else r], True)


def _count(texts: DataFrame, order: int, shards: int, turn: int, turns: int) -> DataFrame:
    """(shard, blob) of the n-grams of the highest order, of the ranges whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush():
            nonlocal waiting, size
            words, per = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            waiting, size = [], 0
            kinds, ids = np.unique(np.r_[words, BEGIN], return_inverse=True)
            begin, ids = ids[-1].astype(np.uint32), ids[:-1].astype(np.uint32)
            place = np.arange(len(words)) - np.repeat(np.cumsum(per) - per, per)
            columns = []
            for back in range(order - 1, -1, -1):
                column = np.full(len(ids), begin)
                column[back:] = np.where(place[back:] >= back, ids[: len(ids) - back], begin)
                columns.append(column)
            own = contexts(words, per, order)[-1] if order > 1 else words
            own = np.flatnonzero(own % U(shards) % U(turns) == U(turn))
            del words, place
            ids, n, _ = _merged([c[own] for c in columns], len(kinds), [])
            rows = list(_dealt(kinds, ids, n, n, shards))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "blob"])

        for b in batches:
            for part in _parts(b.column(0)):
                waiting.append(tokens(part))
                size += len(waiting[-1][0])
                if size >= COUNTED:
                    yield flush()
        if waiting:
            yield flush()

    return texts.mapInArrow(run, "shard int, blob binary")


def _parts(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Stretches of texts with no more than `most` bytes together, or one text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri.removeprefix("file:"))


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """A repeated or speculative attempt writes the same bytes under another name first."""
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(_pack(arrays, False))
    fs.move(own, f"{path}/{name}")


@lru_cache(MAPS)
def _mapped(folder: str, name: str) -> list[np.ndarray] | None:
    """The arrays of one range, mapped from the shared file where that has a path here, else read; as many ranges stay
    open as MAPS at most. None where no n-gram fell into the range."""
    fs, path = _filesystem(f"{folder}")
    path = f"{path}/{name}"
    try:
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):
            with fs.open_input_stream(path) as f:
                return _unpack(f.read(), False)
        with open(path, "rb") as f:
            return _unpack(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ), False)
    except FileNotFoundError:
        return None


def _indexed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each bucket of a sorted hash array starts, the 32 bits of each hash that follow the bucket's, and the order.
    A bucket is known by as many leading bits as give it about a dozen hashes."""
    bits = max(1, min(28, len(keys).bit_length() - 4))
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
    return starts, (keys >> U(32 - bits) & U(0xFFFFFFFF)), order


def _looked_up(starts: np.ndarray, low: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and where: binary searches within buckets, all at once."""
    bits = (len(starts) - 1).bit_length() - 1
    bucket = (keys >> U(64 - bits)).astype(np.int64)
    want = (keys >> U(32 - bits) & U(0xFFFFFFFF)).astype(np.uint32)
    lo = starts[bucket].astype(np.int64)
    size = starts[bucket + 1].astype(np.int64) - lo
    there = np.flatnonzero(size)
    at, size, want = lo[there], size[there], want[there]
    for _ in range(int(size.max() - 1).bit_length() if len(size) else 0):
        half = size >> 1
        at += half * (low[at + half - 1] < want)
        size -= half
    at += low[at] < want
    end = starts[bucket[there] + 1]
    hit = at < end
    hit[hit] = low[at[hit]] == want[hit]
    lo[there] = at
    found = np.zeros(len(keys), bool)
    found[there] = hit
    return found, lo


def _coded(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Of each row the number of its combination, and the combinations, column by column; that of ones and zeros, as
    most rows have it, is the first."""
    plain = np.logical_and.reduce([c == (i < 2) for i, c in enumerate(columns)])
    rest = [c[~plain].astype(U) for c in columns]
    code, at = np.zeros(len(rest[0]), np.int64), np.zeros(len(rest[0]), np.int64)
    for c in rest:
        kinds, c = np.unique(c, return_inverse=True)
        _, at, code = np.unique(code * max(1, len(kinds)) + c, return_index=True, return_inverse=True)
    codes = np.zeros(len(plain), U)
    codes[~plain] = code.astype(U) + U(1)
    return [codes, *(np.r_[U(i < 2), c[at]] for i, c in enumerate(rest))]


def _gather(blobs: DataFrame, order: int, shards: int, folder: str) -> DataFrame:
    """Write the arrays of one order; a row per shard: counts of counts (n1 to n4), their number, the sum of counts, the
    raw sum, and as `next` the blobs of the next lower order.

    A range's arrays: of its n-grams the index, counts by code and (for words) raw counts, or of its contexts the index,
    and by code the sum of counts and how many words have a count of 1, of 2, of more."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(blob, True) for blob in table.column("blob").to_pylist()]
        own = [np.cumsum(p[0], dtype=U) for p in parts]
        kinds = np.unique(np.concatenate(own))
        places = [np.searchsorted(kinds, k).astype(np.uint32) for k in own]
        ids = [np.concatenate([at[p[1 + i]] for p, at in zip(parts, places, strict=True)]) for i in range(order)]
        n = np.concatenate([p[1 + order].astype(np.uint32) for p in parts])
        raw = np.concatenate([(p[2 + order] if len(p[2 + order]) else p[1 + order]).astype(U) for p in parts])
        del parts, own, places
        ids, _, (n, raw) = _merged(ids, len(kinds), [n, raw])
        words = [kinds[x] for x in ids]
        context = _context(words)
        shard = table.column("shard")[0].as_py()
        starts, low, by = _indexed(_joined(context, words[-1]))
        _save(folder, f"{order}-{shard}", [starts, low, *_coded([n[by]]), raw[by] if order == 1 else raw[:0]])
        if order > 1:
            new = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in ids[:-1]])])
            of = lambda x: np.add.reduceat(x.astype(U), new)
            starts, low, by = _indexed(context[new])
            _save(folder, f"{order}-{shard}-contexts", [starts, low, *_coded([x[by] for x in (of(n), of(n == 1), of(n == 2), of(n >= 3))])])
        rows = []
        if order > 1:
            shorter, kept, (sums,) = _merged(ids[1:], len(kinds), [raw])
            rows = [(shard, s, b, *[0] * 7) for s, b in _dealt(kinds, shorter, kept, sums, shards)]
        rows = [(shard, None, None, *[int((n == k).sum()) for k in (1, 2, 3, 4)], len(n), int(n.sum()), int(raw.sum())), *rows]
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate([("shard", pa.int32()), ("next", pa.int32()), ("blob", pa.binary()), *((x, pa.int64()) for x in ("n1", "n2", "n3", "n4", "kinds", "total", "raw"))])})

    return blobs.groupBy("shard").applyInArrow(run, "shard int, next int, blob binary, n1 long, n2 long, n3 long, n4 long, kinds long, total long, raw long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts 1, 2 and 3 or more; 0.5, 1 and 1.5 where the counts of counts give none."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


class Model:
    """What workers need to find the arrays: small, whatever the corpus."""

    def __init__(self, folder: str, order: int, shards: int, stats: dict[int, list[int]]):
        self.folder, self.order, self.shards = folder, order, shards
        self.discounts = {m: discounts(*stats[m][:4]) for m in stats}
        few = stats[1]
        self.vocabulary, self.total, self.tokens = few[4], few[5], few[6]
        d = self.discounts[1]
        spare = d[0] * few[0] + d[1] * few[1] + d[2] * (few[4] - few[0] - few[1])
        self.rest = spare / self.total if self.total else 1.0

    def _find(self, name: str, keys: np.ndarray, deal: np.ndarray, columns: int, plain: int = -1) -> list[np.ndarray]:
        """The values that the ranges' arrays have for the keys, by code but for the column `plain`; zero where a key is
        not there."""
        out = [np.zeros(len(keys)) for _ in range(columns)]
        order, cut = _by_range(deal, self.shards)
        for s in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[s] : cut[s + 1]]
            if arrays := _mapped(self.folder, name.format(s)):
                starts, low, code, *tables = arrays
                there, at = _looked_up(starts, low, keys[own])
                own, at = own[there], at[there]
                c = code[at]
                for i, (o, t) in enumerate(zip(out, tables, strict=False)):
                    o[own] = t[at if i == plain else c]
        return out

    def _discounted(self, m: int, n: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[m]])
        return n - d[np.minimum(n, 3).astype(np.int64)]

    def score(self, words: np.ndarray, backs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: its count in training, and log10 of its probability."""
        kinds, of = np.unique(words, return_inverse=True)
        n, raw = self._find("1-{}", _joined(np.zeros(len(kinds), U), kinds), kinds, 2, 1)
        p = ((self._discounted(1, n) / self.total if self.total else np.zeros(len(n))) + self.rest / (self.vocabulary + 1))[of]
        for m in range(2, self.order + 1):
            kinds, at = np.unique(backs[m - 1], return_inverse=True)
            total, *few = self._find(f"{m}-{{}}-contexts", kinds, kinds, 4)
            spare = sum(d * f for d, f in zip(self.discounts[m], few, strict=True))
            known = total > 0
            back = np.where(known, spare / np.where(known, total, 1), 1.0)[at]
            (n,) = self._find(f"{m}-{{}}", _joined(backs[m - 1], words), backs[m - 1], 1)
            p = self._discounted(m, n) / np.where(known, total, 1)[at] + back * p
        return raw[of], np.log10(p)


def train(texts: DataFrame, order: int = 3, shard_chars: int = 16 << 20, turns: int = 2) -> Model:
    """The model of all rows of texts (a binary column). The ranges are as many as the corpus needs at shard_chars
    bytes each, so that a task's memory doesn't grow with it. They are counted in turns, so that only a part of what
    moves is on disks at a time; texts are read once a turn."""
    spark = texts.sparkSession
    column = texts.columns[0]
    texts = texts.select(F.coalesce(F.col(column), F.lit(b"")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    shards = max(8, -(-size // shard_chars))
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    stats, rows = {}, None
    for m in range(order, 0, -1):
        parts = []
        for turn in range(turns):
            if rows is None:
                blobs = _count(texts, order, shards, turn, turns)
            else:
                blobs = rows.where(F.col("next") % turns == turn).select(F.col("next").alias("shard"), "blob")
            parts.append(stored(_gather(blobs, m, shards, folder), f"lm-counts-{m}-{turn}"))
        if rows is not None:
            removed(rows)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "n4", "kinds", "total", "raw")]).first()
        stats[m] = [int(x) for x in sums]
    return Model(folder, order, shards, stats)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 7, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def lm_scores(docs: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text, a row per row; the model
    learns from the rows that are not held out.

    A null text is empty: it has its end as its only token. Base scores are of the add-one unigram model. Without any
    text to learn from all tokens are unknown and each has probability 1. Null ids and repeated rows each count."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    model = train(own.where(~F.col("held_out")).select("text"), order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, known, base, score = [], [], [], []
            for part in _parts(b.column(2), SCORED * 6):
                words, per = tokens(part)
                raw, p = model.score(words, contexts(words, per, model.order))
                start = np.cumsum(per) - per
                counts.append(per)
                known.append(np.add.reduceat((raw > 0).astype(np.int64), start))
                base.append(np.add.reduceat(np.log10((raw + 1) / (model.tokens + model.vocabulary + 1)), start))
                score.append(np.add.reduceat(p, start))
            join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), join(counts, pa.int64()), join(known, pa.int64()), pa.array(np.full(b.num_rows, model.tokens), pa.int64()), join(base, pa.float64()), join(score, pa.float64())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return own.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
