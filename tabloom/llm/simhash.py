"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

A tree over all fingerprints would grow with the corpus, and so would its broadcast. Fingerprints are therefore dealt
into shards by keys that near fingerprints share; each shard of bounded size gets its own tree, in the task that holds
it, and only edges within the radius are followed.

* ``link_fingerprints``: exact for a small radius r. The 64 bits are cut into r + 1 blocks; two fingerprints at most r
  apart agree in one block whole. A block of bits that more than ``hot`` fingerprints share is split: the other bits are
  cut into r + 1 blocks again, of which two near fingerprints agree in one, until groups are small. Links come from trees
  alone.
* ``near_groups``: for texts of a given shingle similarity. Fingerprints are linked as above, and trees over what has so
  come together find pairs of a wider radius; all are verified on the exact sets of shingles. Similar texts may lie any
  number of bits apart: of those farther than the trees reach, every pair that shares a band of minimum hashes is
  verified as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabloom.llm._common import by_pieces, joined, small, stored
from tabloom.llm.bktree import BKTree, Forest
from tabloom.llm.components import components

SEED = 42
#: Words of a long text whose bits are unpacked at a time.
CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of size words, joined by a space; of the whole sequence if it has fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    line = b" ".join(words)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(start[:n].tolist(), end[size - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long. A null or empty text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(shingle_hashes(t, size)) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _shard_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fps: positions and those of their roots."""
    tree, forest = BKTree(fps.view(np.uint64)), Forest(len(fps))
    for q, k in tree.within(fps.view(np.uint64), radius):
        go = q < k
        forest.join_all(q[go], k[go])
    up = forest.flatten()
    moved = np.flatnonzero(up != np.arange(len(fps)))
    return moved, up[moved]


def _edges_by_shard(shards: DataFrame, radius: int) -> DataFrame:
    """(u, v) from (shard, fp): links within each shard, a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy())
        a, b = _shard_links(fps, radius)
        return pa.table({"u": pa.array(fps[a], pa.int64()), "v": pa.array(fps[b], pa.int64())})

    return shards.groupBy("shard").applyInArrow(run, "u long, v long")


def link_fingerprints(fps: DataFrame, radius: int = 2, shard_rows: int = 8192, hot: int = 2048) -> DataFrame:
    """(node, root) of all linked fingerprints; root is the smallest signed fingerprint of its component.

    fps: a column fp of distinct longs. Every link at most radius bits long counts. radius is 0, 1 or 2. Groups of over
    hot fingerprints are split by blocks of the bits that they needn't share yet; at last 13 such bits are left, or
    fewer, and with them 8,192 fingerprints at most."""
    if not 0 <= radius <= 2:
        raise ValueError("link_fingerprints is exact for a radius of at most 2")
    parts, edges = radius + 1, None
    paths: list[tuple[list[int], list[int]]] = [([], list(range(64)))]  # bits that a group shares, and the others
    rows = fps.select("fp", F.lit(0).alias("path"))
    while True:
        cut = lambda rest, j: rest[len(rest) * j // parts : len(rest) * (j + 1) // parts]
        paths = [(shared + cut(rest, j), [b for b in rest if b not in cut(rest, j)]) for shared, rest in paths for j in range(parts)]
        last = max(len(rest) for _, rest in paths) <= 13
        masks = [sum(1 << b for b in shared) for shared, _ in paths]
        mask = F.array(*[F.lit(m - (1 << 64) * (m >> 63)).cast("long") for m in masks])
        dealt = rows.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda j: F.col("path") * parts + j)).alias("path"))
        dealt = dealt.select("fp", "path", F.col("fp").bitwiseAND(F.element_at(mask, F.col("path") + 1)).alias("bits"))
        sizes = stored(dealt.groupBy("path", "bits").agg(F.count("*").alias("size")).where("size > 1"), "simhash-sizes")
        dealt = stored(joined(dealt, sizes, ["path", "bits"], counts=sizes.withColumnRenamed("size", "joined_n")), "simhash-blocks")
        cold = dealt if last else dealt.where(F.col("size") <= hot)
        shards = max(1, -(-cold.count() // shard_rows))
        found = _edges_by_shard(cold.select(F.pmod(F.xxhash64("path", "bits"), F.lit(shards)).alias("shard"), "fp"), radius)
        edges = found if edges is None else edges.unionByName(found)
        rows = dealt.where(F.col("size") > hot).select("fp", "path")
        if last or not rows.head(1):
            return components(edges, "simhash-links")


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id reachable over fingerprints
    at most radius bits apart, itself included; one row per row of docs.

    Null and empty texts have fingerprint zero and are linked like any other. A row without doc_id keeps its place: its
    component_id is the smallest doc_id there is in its component, null if there is none. Repeated rows stay; an empty
    table gives an empty one; other columns are not read."""
    own = stored(fingerprints(docs, size), "simhash-fingerprints")
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("joined_n")), "simhash-nodes")
    links = link_fingerprints(nodes.select("fp"), radius)
    rooted = stored(nodes.join(links.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined(rooted, named, ["root"]).select("fp", "component_id")
    return joined(own, of, ["fp"], counts=nodes.select("fp", "joined_n")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicates by shingle similarity.

#: Odd multipliers of the minimum hashes come from this seed.
MIN_SEED = 20_011


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(MIN_SEED)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def _bands(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    a, b = _multipliers(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096] ^ (hashes[at : at + 4096] >> np.uint64(31))
        for i in range(bands * rows):
            least[i] = min(least[i], (mixed * a[i] + b[i]).min())
    code = least.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        out = (out ^ code[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, raw (a hash of the text), node (a hash of the normalised words), fp (the fingerprint's bits) and one hash
    per band; texts without words are left out."""

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        at, nodes, fps, keys = [], [], [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            words = (t or b"").lower().split()
            if not words:
                continue
            h = shingle_hashes(t, size)
            fps.append(fingerprint(h))
            h = np.unique(h)
            at.append(i)
            nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED + 1))
            keys.append(_bands(h, bands, rows).view(np.int64).tolist())
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        own = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(2).take(own), as_long(nodes), as_long(fps), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "raw", "node", "fp", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_pieces(batches, made)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.xxhash64("text"))
    return own.mapInArrow(run, "doc_id long, raw long, node long, fp long, bands array<long>")


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _edge_table(us: list[int], vs: list[int]) -> pa.Table:
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _verified(dealt: DataFrame, size: int, similarity: float, reach: int) -> DataFrame:
    """(u, v) from (part, p, q, block, node, fp, bands, text): pairs of block p with block q, or within one, that have the
    similarity; those that other pairs link already are left out. A tree over the fingerprints of q finds the pairs at
    most reach bits apart, which are verified first; then come the others that share a band."""

    def run(table: pa.Table) -> pa.Table:
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        fps = table.column("fp").to_numpy().view(np.uint64)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sets = [np.unique(shingle_hashes(t, size)) for t in table.column("text").to_pylist()]
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        forest, us, vs = Forest(len(node)), [], []
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)

        def verify(xs: np.ndarray, ys: np.ndarray):
            up = forest.flatten()
            open_ = up[xs] != up[ys]
            for x, y in zip(xs[open_].tolist(), ys[open_].tolist(), strict=True):
                if forest.find(x) != forest.find(y) and _similar(sets[x], sets[y], similarity):
                    forest.join(x, y)
                    us.append(node[x])
                    vs.append(node[y])

        for at, to in BKTree(fps[right]).within(fps[left], reach, block=128):
            xs, ys = left[at], right[to]
            own = ys > xs if p == q else ys != xs
            verify(xs[own], ys[own])
        for x in left.tolist():
            far = right[np.bitwise_count(fps[right] ^ fps[x]) > reach]
            far = far[(bands[far] == bands[x]).any(1)]
            far = far[far > x if p == q else far != x]
            verify(np.full(len(far), x), far)
        return _edge_table(us, vs)

    return dealt.groupBy("part", "p", "q").applyInArrow(run, "u long, v long")


def _stars(dealt: DataFrame, size: int, similarity: float) -> DataFrame:
    """(u, v) from (low, block, node, text): the nodes of each block that have the similarity to the node low, v, which
    lies in every block of its set."""

    def run(table: pa.Table) -> pa.Table:
        low, us = table.column("low")[0].as_py(), []
        nodes, texts = table.column("node").to_pylist(), table.column("text")
        if low in nodes:
            first = np.unique(shingle_hashes(texts[nodes.index(low)].as_py(), size))
            us = [n for i, n in enumerate(nodes) if n != low and _similar(first, np.unique(shingle_hashes(texts[i].as_py(), size)), similarity)]
        return _edge_table(us, [low] * len(us))

    return dealt.groupBy("low", "block").applyInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 4, shard_rows: int = 1024, block_rows: int = 1024, radius: int = 2, reach: int = 18) -> DataFrame:
    """(doc_id, raw, group_id), raw being xxhash64 of the text: the smallest doc_id of the texts linked by a Jaccard similarity of at least `similarity` of
    their sets of shingles. Each text that has words gets a row.

    Exact copies (equal words) are one node. All nodes' fingerprints are linked within radius (see link_fingerprints);
    nodes that these links hold together meet under their least node, and so do nodes that share a band of minimum
    hashes. Nodes under one least node are a set, in which trees find the pairs at most reach bits apart. These pairs are
    verified on whole texts, and so is every other pair that shares a band. Sets of up to
    block_rows nodes are dealt into shards of about shard_rows nodes. A larger set is cut into blocks, in each of which
    all nodes are first held against the least one; two nodes that it links need no more, so that only blocks of the
    others are paired, with all blocks. A set of any size needs no more memory than two blocks, and one whose nodes are
    near copies of one text moves each text twice. Only a spanning forest of the links goes on. Rows without doc_id have
    groups too; a group without any id has none."""
    own = stored(_sketches(docs, size, bands, rows), "near-sketches")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.count("*").alias("joined_n"))
    nodes = stored(nodes, "near-nodes")
    fps = stored(nodes.groupBy("fp").agg(F.count("*").alias("joined_n")), "near-fingerprints")
    links = link_fingerprints(fps.select("fp"), radius).select(F.col("node").alias("fp"), "root")
    roots = stored(fps.join(links, "fp", "left").select("fp", F.coalesce("root", "fp").alias("band"), "joined_n"), "near-roots")
    near = joined(nodes.select("node", "fp"), roots.select("fp", "band"), ["fp"], counts=roots.select("fp", "joined_n"))
    keys = nodes.select("node", F.explode("bands").alias("band")).unionByName(near.select("node", "band"))
    lows = stored(keys.groupBy("band").agg(F.count("*").alias("joined_n"), F.min("node").alias("low")).where("joined_n > 1"), "near-lows")
    members = stored(joined(keys, lows.select("band", "low"), ["band"], counts=lows.select("band", "joined_n")).select("low", "node").distinct(), "near-members")
    counts = stored(members.groupBy("low").agg(F.count("*").alias("members")), "near-counts")
    few = counts.where(F.col("members") <= block_rows).agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("low"), F.lit(max(1, -(-few // shard_rows))))
    members = stored(joined(members, counts, ["low"], counts=counts.withColumnRenamed("members", "joined_n")), "near-sets")
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id")
    first = own.select(id_of, "raw", "node").groupBy("node").agg(F.min(F.struct("id", "raw")).alias("x"))
    first = stored(first, "near-firsts")  # else the semi join is moved below the minimum, and all copies of a text meet
    first = first.join(members.select("node").distinct(), "node", "left_semi").select("node", "x.*")
    texts = docs.select(id_of, F.xxhash64("text").alias("raw"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(small(stored(first, "near-first")), ["id", "raw"]).dropDuplicates(["node"]).select("node", "text")
    cold = members.where(F.col("members") <= block_rows).select(F.struct(F.lit(False).alias("large"), shard.alias("of")).alias("part"), "node").distinct()
    dealt = cold.select("part", "node", *[F.lit(0).alias(c) for c in ("block", "p", "q")])
    edges = None
    if counts.where(F.col("members") > block_rows).head(1):
        texts = stored(texts, "near-texts")
        large = members.where(F.col("members") > block_rows)
        number = F.ceil(F.col("members") / block_rows).cast("int")
        block = F.pmod(F.hash("node"), number)
        each = large.where("node <> low").select("low", "node", block.alias("block"))
        least = counts.where(F.col("members") > block_rows).select("low", F.col("low").alias("node"), F.explode(F.sequence(F.lit(0), number - 1)).alias("block"))
        edges = stored(_stars(each.unionByName(least).join(texts, "node"), size, similarity), "near-stars")
        linked = edges.select(F.col("u").alias("node"), F.col("v").alias("low"), F.lit(True).alias("linked"))
        large = large.select("low", "node").join(linked, ["low", "node"], "left").select("low", "node", (F.coalesce("linked", F.lit(False)) | (F.col("low") == F.col("node"))).alias("linked"))
        sums = stored(large.groupBy("low").agg(F.count("*").alias("joined_n"), F.ceil(F.count_if("linked") / block_rows).cast("int").alias("a"), F.ceil(F.count_if(~F.col("linked")) / block_rows).cast("int").alias("b")), "near-blocks")
        large = joined(stored(large, "near-large"), sums.select("low", "a", "b").where("b > 0"), ["low"], counts=sums.select("low", "joined_n"))
        large = large.withColumn("block", F.when(F.col("linked"), F.pmod(F.hash("node"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.hash("node"), F.col("b"))))
        others = F.sequence(F.when(F.col("linked"), F.col("a")).otherwise(F.lit(0)), F.col("a") + F.col("b") - 1)
        pairs = F.transform(others, lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q")))
        dealt = dealt.unionByName(large.select(F.struct(F.lit(True).alias("large"), F.col("low").alias("of")).alias("part"), "node", "block", F.inline(pairs)))
    found = _verified(dealt.join(texts.join(nodes.select("node", "fp", "bands"), "node"), "node"), size, similarity, reach)
    exact = components(found if edges is None else found.unionByName(edges), "near-exact")
    rooted = stored(nodes.join(exact, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "near-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("group_id"))
    of = joined(rooted, named, ["root"]).select("node", "group_id")
    return joined(own.select("doc_id", "raw", "node"), of, ["node"], counts=nodes.select("node", "joined_n")).select("doc_id", "raw", "group_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without the rows whose text has a near-duplicate of smaller doc_id, linked by any number of steps (see
    near_groups); of several rows of one doc_id with equal texts one stays. Texts without words stay, and so do rows
    without a doc_id where their whole group has none. Other columns are carried along, whatever their names."""
    groups = stored(near_groups(docs, **how), "near-groups")
    lost = small(stored(groups.where("group_id is not null and not (doc_id <=> group_id)").select("doc_id", "raw").distinct(), "near-lost")).alias("near_lost")
    own = docs.alias("near_docs")
    same = lambda t: F.col("near_docs.doc_id").cast("long").eqNullSafe(F.col(f"{t}.doc_id")) & (F.xxhash64(F.col("near_docs.text")) == F.col(f"{t}.raw"))
    left = own.join(lost, same("near_lost"), "left_anti")
    twice = stored(groups.where("doc_id is not null").groupBy("doc_id", "raw").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "raw"), "near-twice")
    if not twice.head(1):
        return left
    twice, left = small(twice).alias("near_twice"), left.alias("near_docs")
    return left.join(twice, same("near_twice"), "left_anti").unionByName(left.join(twice, same("near_twice"), "left_semi").dropDuplicates(["doc_id", "text"]))
