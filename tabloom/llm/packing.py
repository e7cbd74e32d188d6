"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest length. Pieces are dealt evenly into shards, each packed by itself
in falling order of size: a piece goes to the open bin that it fills best. Where none has room a bin is opened, and its
length is chosen among all permitted ones together: for each, the pieces that are still to come are tried in it, and the
length wins that costs least for a token that it then holds. At last every bin is downsized to the smallest permitted
length that holds its contents."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm._common import stored

#: Permitted sequence lengths in tokens; what a sequence costs besides its length; the length at which attention, whose
#: cost grows with the square, costs as much as all else.
CAPACITIES, OVERHEAD, BALANCE = (512, 1024, 2048, 4096), 32, 16_384


def cost(capacity: int) -> float:
    """Of one sequence of a length."""
    return capacity + capacity * capacity / BALANCE + OVERHEAD


def word_tokens(text: Column) -> Column:
    """Words (runs of anything but space and 09 to 0D) and one end; null: the end only."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


class _Left:
    """Pieces still to come: how many of each size, and the sizes that there are as the bits of one number."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.some = sum(1 << s for s in self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.some ^= 1 << size

    def fill(self, room: int) -> int:
        """Tokens that the pieces to come, the largest that fits first, bring into a room."""
        start, rest = room, self.some
        while room and (fits := rest & ((1 << (room + 1)) - 1)):
            size = fits.bit_length() - 1
            room -= size * min(self.count[size], room // size)
            rest &= (1 << size) - 1
        return start - room


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, price: Callable[[int], float] = cost) -> tuple[list[int], list[int], list[int]]:
    """Of each piece its bin and its offset there; of each bin its final length. sizes must not rise, and the first must
    fit the largest length."""
    caps = sorted(capacities)
    prices = [price(c) for c in caps]
    by_room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    some, left = 0, _Left(sizes)
    used, bins, offsets = [], [], []
    for size in sizes:
        left.take(size)
        if fits := some >> size:
            space = size + ((fits & -fits).bit_length() - 1)
            b = by_room[space].pop()
            if not by_room[space]:
                some ^= 1 << space
        else:
            least = bisect_right(caps, size - 1)
            space = min(((p / (size + left.fill(c - size)), c) for c, p in zip(caps[least:], prices[least:], strict=True)))[1]
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if room := space - size:
            by_room[room].append(b)
            some |= 1 << room
    return bins, offsets, [caps[bisect_right(caps, u - 1)] for u in used]


def pieces(docs: DataFrame, tokens: Column, most: int) -> DataFrame:
    """doc_id, piece (from 0), first (its first token in the document), size and text, of documents of `tokens` tokens
    each. Where the tokens are words, a piece's text has its words, with the white space that follows each."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.cast("long").alias("n"), F.col("text").cast("string").alias("text")).where("n > 0")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    numbers = F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {most} as int)"))
    cut = F.transform(numbers, lambda i: F.array_join(F.slice("words", i * most + 1, F.lit(most)), ""))
    own = own.withColumn("words", F.when(F.col("n") > most, words)).withColumn("parts", F.when(F.col("n") > most, cut).otherwise(F.array(F.coalesce("text", F.lit("")))))
    own = own.select("doc_id", "n", F.posexplode("parts").alias("piece", "text"))
    first = F.col("piece").cast("long") * most
    return own.select("doc_id", F.col("piece").cast("long").alias("piece"), first.alias("first"), F.least(F.lit(most), F.col("n") - first).alias("size"), "text")


def best_fit(docs: DataFrame, tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, price: Callable[[int], float] = cost, shard_rows: int = 16_384, least_shards: int = 16) -> DataFrame:
    """doc_id, piece, first, size, text, bin (shard and number), offset and bin_size: a row per piece of every document.

    tokens is an expression over docs, word_tokens of the text by default; rows where it is null or not positive have
    nothing to pack. A null or empty text is its end alone, a piece of one token and no text. Null ids and repeated rows
    are packed each for itself: rows are dealt by their place in the written table of pieces, not by id, so that no
    shard is larger for one id's sake; equal sizes keep that order. An empty table gives an empty one; other columns
    than doc_id and text are not read. Only sizes go to the tasks that pack; texts meet their bins in a join by place."""
    own = pieces(docs, word_tokens(F.col("text")) if tokens is None else tokens, max(capacities)).withColumn("row", F.monotonically_increasing_id())
    table = stored(own, "packing-pieces")
    shards = max(least_shards, -(-table.count() // shard_rows))
    dealt = table.select("row", "size", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))

    def run(t: pa.Table) -> pa.Table:
        size, place = t.column("size").to_numpy(), t.column("row").to_numpy()
        order = np.lexsort((place, -size))
        bins, offsets, lengths = pack(size[order].tolist(), capacities, price)
        shard = t.column("shard")[0].as_py()
        return pa.table({"row": place[order], "bin": [f"{shard}-{b}" for b in bins], "offset": pa.array(offsets, pa.int64()), "bin_size": pa.array([lengths[b] for b in bins], pa.int64())})

    packed = dealt.groupBy("shard").applyInArrow(run, "row long, bin string, offset long, bin_size long")
    return table.join(packed, "row").drop("row")


def sequences(packed: DataFrame, end: str = "\x1e") -> DataFrame:
    """bin, bin_size, used, doc_ids and text: a row per packed sequence, from best_fit's rows. doc_ids and the parts of
    the text stand in the order of their places, each part closed by `end`; a bin's length bounds its row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "text")))
    by_bin = packed.groupBy("bin").agg(F.first("bin_size").alias("bin_size"), F.sum("size").alias("used"), parts.alias("parts"))
    return by_bin.select("bin", "bin_size", "used", F.col("parts.doc_id").alias("doc_ids"), F.array_join(F.transform("parts", lambda p: F.concat(p["text"], F.lit(end))), "").alias("text"))
