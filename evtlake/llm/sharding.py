"""Minimax contiguous partition of documents into shards of near equal bytes.

Documents with equal texts are one atomic group. Groups stand in the order of a digest
of their text, and the order is cut into contiguous shards so that the largest shard is
as small as possible: a binary search finds the smallest capacity that a greedy filling
can keep, and the greedy filling with that capacity gives the cuts.

The driver never sees the groups. It sees ends of groups on a grid over the running
total of bytes. Between two known ends others may lie, so the search gives two
capacities: one that surely suffices (cuts at known ends only) and one that nothing
smaller can beat (cuts anywhere in an open cell). Cells where a cut can fall are refined
by one aggregation each round, until both capacities agree and the cuts stand still.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, functions as F

from evtlake.llm.common import stored
from evtlake.plans.ordering import running_totals, sorted_blocks

GRID = 4096


class Ends:
    """Known group ends in ascending order; ``open_[i]`` tells whether unknown ends lie just below ``known[i]``."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end
        self.known, self.open_ = [end], [True]

    def refine(self, cells: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> None:
        """Divide open cells (low, high) at the ``found`` (smallest end, largest end, number of ends) of their parts."""
        merged = dict(zip(self.known, self.open_)) | {high: False for _, high in cells}
        for least, most, n in found:
            merged |= {least: False, most: n > 2}
        self.known = sorted(merged)
        self.open_ = [merged[e] for e in self.known]

    def fill(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Ends of the shards of a greedy filling; the last one is ``end`` if the capacity suffices."""
        at, cuts = self.start, []
        for _ in range(shards):
            if at >= self.end:
                break
            i = bisect_right(self.known, at + capacity)
            to = self.known[i - 1] if i else self.start
            if i < len(self.known) and self.open_[i] and hopeful:
                to = at + capacity
            at = max(at, to)
            cuts.append(at)
        return cuts

    def capacity(self, shards: int, hopeful: bool) -> int:
        low, high = 0, self.end - self.start
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, hopeful)[-1:] == [self.end]:
                high = mid
            else:
                low = mid + 1
        return low

    def touched(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """Open cells in which some cut can fall for capacities from ``low`` to ``high``."""
        least, most = self.fill(low, shards, False), self.fill(high, shards, True)
        cells = {}
        for i in range(shards):
            a = least[i] if i < len(least) else self.end
            b = most[i] if i < len(most) else self.end
            for j in range(bisect_left(self.known, min(a, b)), min(bisect_right(self.known, max(a, b)) + 1, len(self.known))):
                if self.open_[j]:
                    cells[j] = (self.known[j - 1] if j else self.start, self.known[j])
        return [cells[j] for j in sorted(cells)]


def smallest_cuts(ends: DataFrame, start: int, end: int, shards: int, grid: int = GRID) -> list[int]:
    """Running totals at which the shards end; ``ends`` has the running total ``hi`` at the end of each group."""
    state, cells = Ends(start, end), [(start, end)]
    while cells:
        width = max(1, -(-sum(b - a for a, b in cells) // grid))
        lows, highs = (F.expr(f"array({', '.join(f'{c[i]}L' for c in cells)})") for i in (0, 1))
        cell = F.size(F.filter(highs, lambda x: x < F.col("hi")))
        found = (
            ends.where((F.col("hi") > cells[0][0]) & (F.col("hi") < cells[-1][1])).withColumn("cell", cell)
            .where((F.col("hi") > F.get(lows, "cell")) & (F.col("hi") < F.get(highs, "cell")))
            .groupBy("cell", F.expr(f"hi div {width}").alias("part"))
            .agg(F.min("hi").alias("least"), F.max("hi").alias("most"), F.count("*").alias("n")).collect())
        state.refine(cells, [(r.least, r.most, r.n) for r in found])
        low, high = state.capacity(shards, True), state.capacity(shards, False)
        cells = state.touched(low, high, shards)
    return state.fill(high, shards, False)


def minimax_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", grid: int = GRID) -> DataFrame:
    """Return doc_id, size, text_crc32, shard and slot per row of ``docs``.

    A group larger than an even share of what is left gets a shard of its own, first, since
    no cut can make it smaller; the rest is cut by the smallest capacity. Slots number the
    rows of a shard by text digest and id. NULL and empty texts are two groups with size 8 a
    row; repeated rows and NULL ids get slots of their own; an empty table gives no rows;
    other columns are ignored.
    """
    text = F.col(text_col)
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("key")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    largest = rows.groupBy("key").agg(F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "key").limit(shards).collect()
    giants, left, free = [], total, shards
    for g in largest:
        if free == 1 or g.bytes * free <= left:
            break
        giants.append(g.key)
        left, free = left - g.bytes, free - 1
    rank = F.lit(len(giants))
    for i, key in enumerate(giants):
        rank = F.when(F.col("key") == key, i).otherwise(rank)
    order = [F.col("rank"), F.col("key"), F.col("doc_id")]
    blocks = sorted_blocks(rows.withColumn("rank", rank), order)
    placed = stored(running_totals(blocks, {"hi": F.col("size"), "pos": F.lit(1).cast("long")}, ["_blk"], order, inclusive=True), "shard-places")
    ends = stored(placed.where(F.col("rank") == len(giants)).groupBy("key").agg(F.max("hi").alias("hi")).select("hi"), "shard-ends")
    cuts = smallest_cuts(ends, total - left, total, free, grid) if left else []
    shard = F.col("rank")
    for cut in cuts[:-1]:
        shard = shard + F.when(F.col("hi") > cut, 1).otherwise(0)
    out = placed.withColumn("shard", shard.cast("int"))
    first = out.groupBy("shard").agg(F.min("pos").alias("first"))
    return out.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("first")).alias("slot"))
