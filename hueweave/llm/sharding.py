"""Shards of near-equal bytes: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hueweave.llm.common import drop, table, text_or_empty

#: Groups lie on a line by so many bits of a hash of their text. It is looked at by cells of the first FIRST bits, and where a cut may lie, by FINER more bits at a time.
BITS, FIRST, FINER = 60, 12, 8
#: Cells that are looked at more closely in one pass, so that what comes to the driver is bounded: AT_ONCE << FINER rows.
AT_ONCE = 256


def place(text: Column) -> Column:
    """A text's place on the line: the first BITS of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


class Line:
    """What is known of the groups in a row: cells with their sums, each known group by group only where that was asked for.

    A cell is (first hash, bytes, most bytes of a group, groups, bits of its prefix). Positions are bytes from the start; a boundary is a position between two groups."""

    def __init__(self, cells: list[tuple[int, int, int, int, int]]):
        self.cells = sorted(cells)
        self.starts = [0]
        for c in self.cells:
            self.starts.append(self.starts[-1] + c[1])
        self.total = self.starts[-1]
        self.unsure: set[int] = set()

    def many(self, i: int) -> bool:
        return 0 <= i < len(self.cells) and self.cells[i][3] > 1

    def _cell(self, x: int) -> int:
        return bisect_right(self.starts, x) - 1

    def reach(self, x: int, sure: bool) -> int:
        """The last boundary that is not beyond x, or, within a cell of many groups, where it can be at least (sure) or at most."""
        if x >= self.total:
            return self.total
        i = self._cell(x)
        if x == self.starts[i] or not self.many(i):
            return self.starts[i]
        return max(self.starts[i], x - self.cells[i][2] + 1) if sure else x

    def ends(self, cap: int, n: int, sure: bool) -> list[int]:
        """Where the first, second, ... shard ends when filled greedily, as far as n shards go."""
        out = [0]
        while len(out) <= n and out[-1] < self.total:
            out.append(self.reach(out[-1] + cap, sure))
        return out[1:]

    def least(self, n: int, sure: bool) -> int:
        """The least capacity with which n shards hold everything, if cells of many groups are cut at worst (sure) or at best."""
        low = max(max((c[2] for c in self.cells), default=0), -(-self.total // n))
        high = low + max((c[2] for c in self.cells), default=0)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if (self.ends(mid, n, sure) or [0])[-1] >= self.total else (mid + 1, high)
        return low

    def between(self, a: int, b: int) -> list[int]:
        """Cells of many groups that meet a position from a to b."""
        return [i for i in range(max(0, self._cell(a)), min(len(self.cells), self._cell(b) + 1)) if self.many(i)]

    def floor(self, x: int) -> int:
        """The last boundary not beyond x; unsure where that lies within a cell of many groups."""
        i = self._cell(min(x, self.total))
        if x > self.starts[i] and self.many(i):
            self.unsure.add(i)
        return self.starts[i]

    def ceil(self, x: int) -> int:
        """The first boundary not before x, unsure as floor is."""
        i = bisect_left(self.starts, max(x, 0))
        if self.starts[i] != max(x, 0) and self.many(i - 1):
            self.unsure.add(i - 1)
        return self.starts[i]

    def even(self, cap: int, n: int) -> list[int]:
        """Ends of all shards but the last, none above cap: each the boundary nearest the mean of what is left, of those from which the rest still fits."""
        least, all_ = [self.total], self.total
        for _ in range(n - 1):
            least.append(self.ceil(least[-1] - cap))
        out = [0]
        for k in range(1, n):
            p, left = out[-1], n - k + 1
            low, high = self.floor(p + (all_ - p) // left), self.ceil(p - (p - all_) // left)
            near = low if 2 * (all_ - p) <= (low + high - 2 * p) * left else high
            out.append(min(max(near, least[n - k], p), self.floor(p + cap)))
        return out[1:]


def minimax_cuts(look: Callable[[int, list[int] | None, int], list[tuple]], n: int) -> tuple[list[int], int]:
    """First hashes of shards 1, 2, ... (an empty shard has the next one's; beyond the last group: 1 << BITS), and the capacity.

    The capacity is the least that greedy filling meets with n shards, found by bisection over the groups themselves: bounds from cells cut at
    best and at worst say which cells hold a cut at any capacity that may be the least, and these are looked at more closely, until both bounds
    are one. look(bits, prefixes, finer) gives the cells of those prefixes (None: of all)."""
    line = Line(look(0, None, FIRST))

    def closer(at: list[int]) -> Line:
        by: dict[int, list[int]] = {}
        for i in at[:AT_ONCE]:
            by.setdefault(line.cells[i][4], []).append(line.cells[i][0] >> BITS - line.cells[i][4])
        some = set(at[:AT_ONCE])
        more = [c for bits, prefixes in by.items() for c in look(bits, prefixes, bits + FINER)]
        return Line([c for i, c in enumerate(line.cells) if i not in some] + more)

    while True:
        low, cap = line.least(n, False), line.least(n, True)
        if low == cap:
            break
        reach = zip(line.ends(low, n, True), line.ends(cap, n, False), strict=False)
        line = closer(sorted({i for a, b in reach for i in line.between(a, b)}))
    while True:
        line.unsure.clear()
        ends = line.even(cap, n)
        if not line.unsure:
            break
        line = closer(sorted(line.unsure | {j for i in line.unsure for j in (i - 1, i + 1) if line.many(j)}))
    first = {p: c[0] for p, c in zip(line.starts, line.cells, strict=False)}
    return [first.get(p, 1 << BITS) for p in ends], cap


def looker(groups: DataFrame) -> Callable[[int, list[int] | None, int], list[tuple]]:
    """Cells of groups(h, bytes), by sums that are combined before the shuffle."""

    def look(bits: int, prefixes: list[int] | None, finer: int) -> list[tuple]:
        own = groups if prefixes is None else groups.filter(F.shiftright("h", BITS - bits).isin(prefixes))
        finer = min(finer, BITS)
        cells = own.groupBy(F.shiftright("h", BITS - finer).alias("cell")).agg(F.min("h").alias("h"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"), F.count("*").alias("n"))
        return [(r.h, r.bytes, r.most, r.n, finer) for r in cells.select("h", "bytes", "most", "n").collect()]

    return look


def shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text plus 16; a null text counts as an empty one. Documents of equal text (of BITS equal bits of its MD5) are a
    group that shares a shard, even where it outgrows the mean. Slots count from 0 in each shard, by salt of the id, then id (null first), then
    the text's hash; equal rows are counted before they are numbered, so they do not meet in one task. Null ids are kept; an empty table gives no rows;
    columns beyond the id and the text are ignored."""
    text = text_or_empty(F.col(text_col))
    slim = table(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place(text).alias("h")))
    groups = table(slim.groupBy("h").agg(F.sum("size").alias("bytes")))
    cuts, _ = minimax_cuts(looker(groups), n_shards)
    drop(groups)
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("h"))) if cuts else F.lit(0)
    salts = max(64, slim.count() // (n_shards * 20_000))
    salt = F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % salts, F.lit(0))
    rows = slim.withColumns({"shard": shard.cast("int"), "salt": salt})
    rows = rows.groupBy("shard", "salt", "doc_id", "h", "size", "text_crc32").agg(F.count("*").alias("n"))
    line = Window.partitionBy("shard").orderBy("salt")
    before = rows.groupBy("shard", "salt").agg(F.sum("n").alias("n")).select("shard", "salt", (F.sum("n").over(line) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard", "salt").orderBy("doc_id", "h", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    first = rows.withColumn("at", F.sum("n").over(inside) - F.col("n")).join(before, ["shard", "salt"])
    copies = first.withColumn("lot", F.explode(F.expr("sequence(0L, (n - 1) div 65536)"))).withColumn("copy", F.explode(F.expr("sequence(lot * 65536, least(n - 1, lot * 65536 + 65535))")))
    return copies.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") + F.col("copy")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
