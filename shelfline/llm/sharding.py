"""Sharding: minimax contiguous partition of ordered atomic groups.

Equal texts form one group that no cut may split. Groups stand in the order of their SHA-256 digest. The smallest
capacity with which a greedy walk needs no more than the wanted number of shards is found by binary search, and the
cuts are made under that capacity. The walk only ever asks for the group border next to a position. The borders live
in a distributed table; the driver holds a summary of it (first, last and number of borders of a block of positions)
and refines only blocks in which an answer is still open, so what it holds depends on the number of shards and the
depth of refinement, never on the number of documents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage
from .registry import query, table

#: Blocks of the first summary, and how many parts a block falls into when refined.
BLOCKS, FINER = 4096, 64
#: Ranges of digests that get running sums of their own (hexadecimal digits), and cells of a shard that number rows.
RANGE_DIGITS, CELLS = 3, 256


class Borders:
    """Ordered positions at which groups end, known block by block.

    ``blocks`` holds (first border, last border, number of borders) by position. A look-up inside a block with more
    than two borders may be open; such blocks are noted in ``open`` and the lower (or upper) bound is answered.
    """

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total, self.open = ends, total, set()
        self.width = max(1, -(-total // BLOCKS))
        self._set(self._read(None))

    def _read(self, spans: list[tuple[int, int]] | None) -> list[tuple[int, int, int]]:
        found = self.ends
        if spans is not None:
            inside = F.lit(False)
            for low, high in spans:
                inside = inside | F.col("end").between(low, high)
            found = found.where(inside)
        rows = found.groupBy(F.floor(F.col("end") / self.width).alias("block")).agg(
            F.min("end"), F.max("end"), F.count(F.lit(1))).collect()
        return sorted((r[1], r[2], r[3]) for r in rows)

    def _set(self, blocks: list[tuple[int, int, int]]) -> None:
        self.blocks = blocks
        self.firsts = [b[0] for b in blocks]
        self.lasts = [b[1] for b in blocks]

    def refine(self) -> None:
        """Replace the open blocks by finer ones."""
        spans = [(self.blocks[i][0], self.blocks[i][1]) for i in sorted(self.open)]
        kept = [b for i, b in enumerate(self.blocks) if i not in self.open]
        # blocks of different depth may be open together; the finest step that any of them needs serves all
        self.width = max(1, min(self.width, max(high - low + 1 for low, high in spans)) // FINER)
        self.open = set()
        self._set(sorted(kept + self._read(spans)))

    def down(self, position: int, upper: bool = False) -> int:
        """Largest border at or below a position (0 if there is none); ``upper``: answer the upper bound if open."""
        i = bisect_right(self.firsts, position) - 1
        if i < 0:
            return 0
        first, last, count = self.blocks[i]
        if position >= last:
            return last
        if count > 2:
            self.open.add(i)
            return min(position, last - 1) if upper else first
        return first

    def up(self, position: int) -> int:
        """Smallest border at or above a position, or an upper bound of it if open."""
        i = bisect_left(self.lasts, position)
        if i == len(self.lasts):
            return self.total
        first, last, count = self.blocks[i]
        if position <= first:
            return first
        if count > 2:
            self.open.add(i)
        return last

    def fits(self, capacity: int, shards: int, upper: bool = False) -> bool:
        """Whether the greedy walk ends within the shards."""
        position = 0
        for _ in range(shards):
            if position + capacity >= self.total:
                return True
            step = self.down(position + capacity, upper)
            if step <= position:
                return False
            position = step
        return position >= self.total

    def smallest(self, shards: int, upper: bool = False) -> int:
        low, high = max(1, -(-self.total // shards)), self.total
        while low < high:
            middle = (low + high) // 2
            if self.fits(middle, shards, upper):
                high = middle
            else:
                low = middle + 1
        return low

    def capacity(self, shards: int) -> int:
        """The smallest feasible capacity, exact."""
        while True:
            surely, perhaps = self.smallest(shards), self.smallest(shards, upper=True)
            if surely == perhaps:
                self.open = set()
                return surely
            self.open = set()  # the search touched more blocks than its last walks need
            for capacity in (surely, perhaps, surely - 1):
                self.fits(capacity, shards)
                self.fits(capacity, shards, upper=True)
            self.refine()

    def cuts(self, shards: int) -> tuple[int, list[int]]:
        """The capacity and the cut positions: as even as the capacity allows, never beyond it."""
        capacity = self.capacity(shards)
        while True:
            least = [self.total]  # positions from which the rest still fits, last shard first
            for _ in range(shards - 1):
                least.append(self.up(max(0, least[-1] - capacity)) if least[-1] > capacity else 0)
            least = least[::-1]
            found, position = [], 0
            for k in range(shards - 1):
                aim = position + -(-(self.total - position) // (shards - k))
                below, above = self.down(aim), self.up(aim)
                near = below if aim - below <= above - aim else above
                near = max(least[k], min(near, self.down(position + capacity)), position)
                found.append(near)
                position = near
            if not self.open:
                return capacity, found
            self.refine()


def group_ends(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Groups in the order of a hexadecimal digest with the running sum of sizes at which each ends.

    Running sums are made inside fixed ranges of digests; only the totals of the ranges meet, so no task sees all
    groups. A group with very many rows is summed before the shuffle.
    """
    groups = rows.groupBy(group).agg(F.sum(size).alias("group_size")).withColumn(
        "range", F.substring(group, 1, RANGE_DIGITS))
    inside = Window.partitionBy("range").orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    running = cut_lineage(groups.withColumn("end", F.sum("group_size").over(inside)), "group-ends")
    totals = running.groupBy("range").agg(F.sum("group_size").alias("range_size"))
    before = totals.withColumn("before", F.sum("range_size").over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
    # at most 16 ** RANGE_DIGITS rows, whatever the input
    joined = running.join(F.broadcast(before.select("range", "before")), "range")
    return joined.select(group, (F.col("end") + F.col("before")).alias("end"))


def minimax_shards(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards so that the largest shard is as small as possible.

    Returns the id, ``size`` (UTF-8 bytes of the text plus one), ``text_crc32``, ``law`` ("bytes"), ``shard``, ``slot``
    (numbers the rows of a shard from 0 without gaps), ``capacity`` (the minimax shard size) and ``shard_size``.
    Rows with equal texts share a shard; a null text is an empty one; repeated rows each get a slot; an empty table
    gives an empty result; a null id is kept. Other columns do not take part. A group larger than the mean shard is
    not split: it is an atom, and the capacity is then its size.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group")), "sized")
    ends = cut_lineage(group_ends(rows, "group", "size"), "borders")
    total = ends.agg(F.max("end")).first()[0] or 0
    capacity, positions = Borders(ends, total).cuts(shards) if total else (0, [0] * (shards - 1))
    last = {r["end"]: r["group"] for r in ends.where(F.col("end").isin(sorted(set(positions) - {0}))).collect()}
    shard: Column = F.lit(0)
    for position in positions:
        shard = shard + (F.col("group") > F.lit(last.get(position, ""))).cast("int")
    placed = rows.withColumns({"shard": shard, "cell": F.pmod(F.xxhash64("id", "group"), F.lit(CELLS)).cast("int")})
    per_cell = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_cell.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"),
                             F.sum("bytes").over(Window.partitionBy("shard")).alias("shard_size"))
    # at most shards * CELLS rows
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "group")))
    return numbered.join(F.broadcast(starts), ["shard", "cell"]).select(
        F.col("id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place") - 1).alias("slot"), F.lit(capacity).cast("long").alias("capacity"),
        "shard_size")


@query("op1_minimax_shards")
def op1_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = minimax_shards(table(spark, folder, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot",
                        F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "capacity", "shard_size")
