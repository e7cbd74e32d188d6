"""Benchmark decontamination by winnowing (Schleimer et al., 2003).

Of every ``window`` consecutive k-gram hashes the smallest is kept, on both sides. Where two texts share window + k - 1
words, they share all k-grams of one window, and so its minimum: every shared span of that length is found. Hits are
then extended word by word, which also drops collisions of hashes."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm._common import by_pieces, joined, stored

#: A-Z become a-z, and what is neither a digit, nor a letter, nor beyond ASCII separates words.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Texts that a worker takes apart at a time.
ROWS = 256


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive ids; NONE where one is unknown (negative). Never NONE else."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(k):
        part = ids[i : i + n]
        h = (h ^ (part.astype(np.uint64) + np.uint64(1))) * MIX
        h ^= h >> np.uint64(32)
        known &= part >= 0
    return np.where(known, h & ~np.uint64(1), NONE)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of each window; NONE is never kept."""
    n = len(hashes) - window + 1
    if n <= 0:
        at = np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.empty(0, np.int64)
    else:
        view = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
        at = np.unique(np.arange(n) + window - 1 - view.argmin(1))
    return at[hashes[at] != NONE]


class Items:
    """Fingerprints of a block of items. span: words of a window; an item of fewer words is one window."""

    def __init__(self, items: list[tuple[object, bytes | None]], span: int, k: int):
        self.span, self.k, self.window = span, k, span - k + 1
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.ids = [], []
        for name, text in items:
            words = words_of(text)
            if words:
                self.names.append(name)
                self.ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        table, self.short = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for x, ids in enumerate(self.ids):
            if len(ids) < span:
                self.short[len(ids)][int(_grams(ids, len(ids))[0])].append(x)
                continue
            h = _grams(ids, k)
            for p in winnow(h, self.window):
                table[int(h[p])].append((x, int(p)))
        self.short = {n: dict(t) for n, t in self.short.items()}
        self.keys = np.array(sorted(table), np.uint64)
        self.posts = [table[h] for h in self.keys.tolist()]

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == hashes, at, -1) if len(self.keys) else np.full(len(hashes), -1)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words of a text lie in an occurrence of a window, and the items with such windows."""
        hit, found = np.zeros(len(ids), bool), set()
        h = _grams(ids, self.k)
        kept = winnow(h, self.window)
        at = self._known(h[kept])
        done: dict[tuple[int, int], int] = {}
        for p, post in zip(kept[at >= 0].tolist(), at[at >= 0].tolist(), strict=True):
            for x, s in self.posts[post]:
                if done.get((x, p - s), -1) > p:
                    continue
                item = self.ids[x]
                lo = min(p, s)
                hi = min(len(ids) - p, len(item) - s)
                back = np.flatnonzero(ids[p - lo : p][::-1] != item[s - lo : s][::-1])
                on = np.flatnonzero(ids[p : p + hi] != item[s : s + hi])
                a, b = p - (int(back[0]) if len(back) else lo), p + (int(on[0]) if len(on) else hi)
                done[x, p - s] = max(b, p + 1)
                if b - a >= self.span:
                    hit[a:b] = True
                    found.add(x)
        for n, grams in self.short.items():
            for p, g in enumerate(_grams(ids, n).tolist()):
                for x in grams.get(g, ()):
                    if np.array_equal(ids[p : p + n], self.ids[x]):
                        hit[p : p + n] = True
                        found.add(x)
        return hit, found


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends of runs, alternating."""
    return np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).tolist()


def _block(bench: DataFrame, block_bytes: int) -> list[tuple[object, bytes]] | None:
    """The items, if they are no more than block_bytes together; the driver never holds more."""
    size = F.octet_length("text") + F.octet_length("name") + 64
    if (bench.agg(F.sum(size)).first()[0] or 0) > block_bytes:
        return None
    return [(r["name"], bytes(r["text"] or b"")) for r in bench.collect()]


def contamination(docs: DataFrame, bench: DataFrame, span: int = 8, k: int = 5, block_bytes: int = 16 << 20, keep: bool = False) -> DataFrame:
    """doc_id, n_words, hits (array: starts and ends of runs of hit words, alternating) and items (ids of the items that
    have a window in the text, as strings), a row per row of docs.

    A word is hit if it lies in an occurrence of a window: span consecutive words of an item, or a whole item of fewer
    words. Null has no words; an item without words has no window; equal items each count; an empty benchmark hits
    nothing, and empty docs give an empty table. A benchmark of up to block_bytes is broadcast as a table of fingerprints,
    and documents are neither shuffled nor written. A larger one is joined with the documents by fingerprint: pairs of a
    document and an item that share one meet again with their texts, where hits are extended. Other columns are not read,
    unless with `keep` the whole row is carried along as `row`; doc_id may be null or repeat."""
    if not 1 <= k <= span:
        raise ValueError("a k-gram can't be longer than the window")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *([F.struct(*docs.columns).alias("row")] if keep else []))
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text"))
    block = _block(items, block_bytes)
    if block is None:
        return _joined_by_fingerprint(own, items, span, k)
    shared = docs.sparkSession.sparkContext.broadcast(Items(block, span, k))
    fields = "doc_id long, n_words long, hits array<long>, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        get = items.vocabulary.get
        for b in batches:
            counts, runs, names = [], [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                counts.append(len(words))
                hit, found = items.hits(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
                runs.append(_runs(hit))
                names.append([items.names[x] for x in sorted(found)])
            out = [b.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string())), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "hits", "items", *b.schema.names[2:]])

    schema = T.StructType([*T.StructType.fromDDL(fields).fields, *([own.schema["row"]] if keep else [])])
    return own.mapInArrow(run, schema)


def _fingerprints(texts: DataFrame, span: int, k: int, whole: list[int] | None) -> DataFrame:
    """(kind, h, n) from (n, text): of kind 0 the winnowed k-grams of words. Of an item (whole is None) of fewer than
    span words itself, its kind being its number of words; of a document all stretches of the numbers in whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: set[tuple[int, int, int]] = set()
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(t)
                ids = np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in words), np.int64, len(words))
                if whole is not None or len(ids) >= span:
                    h = _grams(ids, k)
                    rows.update((0, int(x), n) for x in h[winnow(h, span - k + 1)].tolist())
                for length in whole if whole is not None else [len(ids)] if 0 < len(ids) < span else []:
                    rows.update((length, int(x), n) for x in _grams(ids, length).tolist())
            own = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int32()), pa.array(np.array([r[1] for r in own], np.uint64).view(np.int64)), pa.array([r[2] for r in own], pa.int64())], ["kind", "h", "n"])

    return texts.select("n", "text").mapInArrow(run, "kind int, h long, n long")


def _joined_by_fingerprint(docs: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """contamination() of a benchmark of any size."""
    own = stored(docs.withColumn("n", F.monotonically_increasing_id()), "bench-docs")
    items = stored(items.withColumn("n", F.monotonically_increasing_id()), "bench-items")
    marks = stored(_fingerprints(items, span, k, None).withColumnRenamed("n", "item"), "bench-marks")
    whole = sorted(r[0] for r in marks.where("kind > 0").select("kind").distinct().collect())  # below span: a few
    found = _fingerprints(own, span, k, whole).join(marks, ["kind", "h"]).select("n", "item").distinct()
    pairs = stored(found, "bench-pairs")
    named = items.select(F.col("n").alias("item"), "name", F.col("text").alias("item_text"))
    texts = joined(joined(pairs, own.select("n", "text"), ["n"]), named, ["item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, text, name, item in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                one, words = Items([(name, item)], span, k), words_of(text)
                hit, found = one.hits(np.fromiter((one.vocabulary.get(w, -1) for w in words), np.int64, len(words)))
                if found:
                    runs = _runs(hit)
                    rows.append((n, [{"lo": lo, "hi": hi} for lo, hi in zip(runs[::2], runs[1::2], strict=True)], name))
            kinds = (pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["n", "runs", "name"])

    hits = texts.select("n", "text", "name", "item_text").mapInArrow(run, "n long, runs array<struct<lo:long,hi:long>>, name string")
    hits = hits.groupBy("n").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.collect_list("name")).alias("items"))
    none = "array_repeat(cast(0 as bigint), 0)"
    one = "(s, x) -> if(s.hi >= x.lo, named_struct('hi', greatest(s.hi, x.hi), 'out', s.out), named_struct('hi', x.hi, 'out', concat(s.out, array(s.hi, x.lo))))"
    merged = f"aggregate(runs, named_struct('hi', cast(-1 as bigint), 'out', {none}), {one}, s -> if(s.hi < 0, {none}, slice(array_append(s.out, s.hi), 2, size(s.out))))"
    n_words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    out = own.join(hits.select("n", F.expr(merged).alias("hits"), "items"), "n", "left")
    return out.select("doc_id", n_words.alias("n_words"), F.coalesce("hits", F.array().cast("array<long>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *(["row"] if "row" in docs.columns else []))


def decontaminated(docs: DataFrame, bench: DataFrame, least_items: int = 1, span: int = 8, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, all their columns, that have windows of fewer than least_items items (see contamination)."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text"))
    block = _block(items, block_bytes)
    if block is None:
        marked = contamination(docs, bench, span, k, block_bytes, keep=True).where(F.size(F.array_distinct("items")) < least_items)
        return marked.select("row.*")
    shared, at = docs.sparkSession.sparkContext.broadcast(Items(block, span, k)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        get = items.vocabulary.get

        def kept(b: pa.RecordBatch) -> pa.RecordBatch:
            stay = []
            for t in b.column(at).to_pylist():
                words = words_of((t or "").encode())
                found = items.hits(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))[1]
                stay.append(len({items.names[x] for x in found}) < least_items)
            return b.filter(pa.array(stay, pa.bool_()))

        return by_pieces(batches, kept, ROWS)  # a few texts at a time are taken apart

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from contamination()."""
    signed = F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x)
    n_items = F.size(F.array_distinct("items")).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(F.array_sort(F.array_distinct("items")), ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def sha256_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()
