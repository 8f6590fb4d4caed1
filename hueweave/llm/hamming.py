"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.llm.common import table
from hueweave.llm.vectors import asked, cells, classes, dealt, merged, usable


def sign_code(vector: str, bits: int):
    """Bit i of a long is set where component i is above zero; bits <= 64."""
    one = F.expr(f"aggregate(transform(sequence(0, {bits - 1}), i -> if(try_element_at({vector}, i + 1) > 0, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)")
    return one


class SegmentIndex:
    """Codes by the value of each of their segments: for a segment, rows in the order of its value, and where each value starts."""

    def __init__(self, codes: np.ndarray, bits: int, width: int):
        self.codes, self.width = codes, width
        self.cuts = list(range(0, bits, width))
        self.masks: dict[tuple[int, int], np.ndarray] = {}
        self.sides = []
        for c in self.cuts:
            w = min(width, bits - c)
            v = (codes >> np.uint64(c) & np.uint64((1 << w) - 1)).astype(np.int64)
            order = np.argsort(v, kind="stable")
            self.sides.append((w, order, np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << w))])))

    def _flips(self, w: int, r: int) -> np.ndarray:
        if (w, r) not in self.masks:
            self.masks[w, r] = np.array([sum(1 << i for i in c) for c in combinations(range(w), r)], np.int64)
        return self.masks[w, r]

    def search(self, code: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of every code that is as near as the kth nearest, or all codes if they are fewer.

        Step (r, j) looks up segment j at radius r. When segments 0 to j are done to radius r and the others to r - 1, a code that was not met is
        farther than (r + 1) * (j + 1) + r * (m - j - 1) - 1; once k verified codes lie within that, nothing nearer or as near can be missing."""
        m, q, seen = len(self.cuts), np.uint64(code), np.zeros(len(self.codes), bool)
        rows, dist, within = [], [], np.zeros(66, np.int64)
        for r in range(self.width + 1):
            for j, c in enumerate(self.cuts):
                w, order, starts = self.sides[j]
                if r <= w:
                    v = self._flips(w, r) ^ int(q >> np.uint64(c) & np.uint64((1 << w) - 1))
                    a, n = starts[v], starts[v + 1] - starts[v]
                    a, n = a[n > 0], n[n > 0]
                    if len(a):
                        near = order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                        near = near[~seen[near]]
                        seen[near] = True
                        d = np.bitwise_count(self.codes[near] ^ q).astype(np.int64)
                        rows.append(near)
                        dist.append(d)
                        within += np.bincount(d, minlength=66)
                covered = (r + 1) * (j + 1) + r * (m - j - 1) - 1
                if within[: covered + 1].sum() >= k:
                    rows_, dist_ = np.concatenate(rows), np.concatenate(dist)
                    kth = int(np.searchsorted(np.cumsum(within), k))
                    return rows_[dist_ <= kth], dist_[dist_ <= kth]
        return (np.concatenate(rows), np.concatenate(dist)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def nearest_codes(vectors: DataFrame, k: int = 10, bits: int = 64, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", per_shard: int = 16_384, block: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, distance: for every row whose id is divisible by `every`, the k others of least Hamming distance between sign
    codes, nearest first, ties to the smaller id. Exact.

    Vectors that are null, zero or hold null or non-finite components, and null ids, take no part; with fewer than k candidates all
    are returned; rows that repeat an id and a code count once, and rows of the query's own id are no candidates. Equal codes are
    one entry with their k + 1 smallest ids. A shard holds about per_shard codes and meets the queries in blocks, so a task's
    memory is bounded; each shard's search is exact, so the merge is. Components that a vector lacks count as zeros. The index of a shard,
    four sorts of per_shard codes, is cheaper to build for each block of queries than to read back."""
    rows = table(vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), sign_code(f"`{vector_col}`", bits).alias("code")))
    entries = table(classes(rows, "code", k))
    entries, shards = dealt(entries, "code", per_shard)
    queries, blocks = asked(rows.filter(F.col("vec_id") % every == 0).distinct().withColumnRenamed("vec_id", "query_id"), shards, block)
    width = 16

    def search(side: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(side) and len(ask):
            index, ids = SegmentIndex(side["code"].to_numpy(np.int64).view(np.uint64), bits, width), side["ids"].to_list()
            for q, code in zip(ask["query_id"].to_list(), ask["code"].to_numpy(np.int64).view(np.uint64).tolist(), strict=True):
                at, d = index.search(code, k + 1)
                near = sorted((x, i) for r, x in zip(at.tolist(), d.tolist(), strict=True) for i in ids[r] if i != q)[:k]
                out += [(q, i, x) for x, i in near]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "distance"]).astype("int64")

    found = cells(entries, queries, shards, blocks, search, "query_id long, vec_id long, distance long")
    return merged(found, F.col("distance"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "distance")
