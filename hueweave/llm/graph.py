"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard, asked by beam search.

Vectors get one more component that makes their lengths equal, after which the nearest by distance is the
largest by inner product."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.llm.common import drop, table
from hueweave.llm.vectors import classes, dealt, merged, usable


def distances(x: np.ndarray, sq: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of q[i] to x[at[i, j]]; at < 0 is infinitely far."""
    d = sq[at] - 2 * np.matmul(x[at], q[:, :, None])[:, :, 0] + np.einsum("id,id->i", q, q)[:, None]
    return np.where(at < 0, np.float32(np.inf), np.maximum(d, 0))


def beam(x: np.ndarray, sq: np.ndarray, links: np.ndarray, entry: int, q: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy searches of all q at once: the `width` nearest met, nearest first, as rows (-1: none) and distances.

    A step opens each beam's `expand` nearest rows that are not opened and merges their links; a search ends when all rows of its beam are open."""
    n = len(q)
    ids = np.full((n, width), -1, np.int32)
    dist = np.full((n, width), np.inf, np.float32)
    opened = np.ones((n, width), bool)
    ids[:, 0], opened[:, 0] = entry, False
    dist[:, 0] = distances(x, sq, q, ids[:, :1])[:, 0]
    live = np.arange(n)
    while len(live):
        i, d, o = ids[live], dist[live], opened[live]
        pick = np.argsort(o, axis=1, kind="stable")[:, :expand]
        nodes = np.where(np.take_along_axis(o, pick, 1), -1, np.take_along_axis(i, pick, 1))
        np.put_along_axis(o, pick, True, 1)
        near = np.where(nodes[:, :, None] < 0, -1, links[nodes]).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        known = np.sort(i, axis=1)
        keyed = np.arange(len(live), dtype=np.int64)[:, None] * (len(x) + 2) + 1
        flat = (known + keyed).ravel()
        want = (near + keyed).ravel()
        pos = np.minimum(np.searchsorted(flat, want), len(flat) - 1)
        near[(flat[pos] == want).reshape(near.shape)] = -1
        dn = distances(x, sq, q[live], near)
        i, d, o = np.concatenate([i, near], 1), np.concatenate([d, dn], 1), np.concatenate([o, near < 0], 1)
        best = np.argpartition(d, width - 1, axis=1)[:, :width]
        d = np.take_along_axis(d, best, 1)
        order = np.argsort(d, axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        ids[live], dist[live] = np.take_along_axis(i, best, 1), np.take_along_axis(d, order, 1)
        opened[live] = np.take_along_axis(o, best, 1)
        live = live[~opened[live].all(axis=1)]
    return ids, dist


def prune(x: np.ndarray, sq: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Links of rows p out of cand (-1: none): the nearest stays and drops each candidate that it is alpha times nearer to than p is, again and again."""
    cand = np.where(cand == p[:, None], -1, cand)
    cand.sort(axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    d = distances(x, sq, x[p], cand)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    width = int((cand >= 0).sum(axis=1).max(initial=0))
    cand, d = cand[:, :width], d[:, :width].copy()
    out, at = np.full((len(p), degree), -1, np.int32), np.arange(len(p))
    if not width:
        return out
    v, s = x[cand], sq[cand]
    far = alpha * alpha * np.maximum(s[:, :, None] + s[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    for k in range(degree):
        near = d.argmin(axis=1)
        good = np.isfinite(d[at, near])
        if not good.any():
            break
        out[good, k] = cand[at, near][good]
        d[far[at, near] <= d] = np.inf
        d[at, near] = np.inf
    return out


def build(x: np.ndarray, degree: int = 24, width: int = 48, alpha: float = 1.2, batch: int = 512, seed: int = 7) -> tuple[np.ndarray, int]:
    """Links (rows of -1-padded neighbours) and the entry, the row nearest the mean.

    Rows come in random order, in batches that double up to `batch`: a batch searches the graph so far, prunes what it met together with its own
    batch's nearest, and is linked back; rows whose links overflow are pruned again."""
    n, sq = len(x), np.einsum("id,id->i", x, x)
    links = np.full((n, degree), -1, np.int32)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int32) if n else order
    done, step = 1, 1
    while done < n:
        p = order[done : done + step]
        met, _ = beam(x, sq, links, entry, x[p], width)
        own = np.tile(p, (len(p), 1))
        if len(p) > 16:
            d = sq[p][None, :] - 2 * x[p] @ x[p].T
            own = p[np.argpartition(d, 15, axis=1)[:, :16]]
        links[p] = prune(x, sq, p, np.concatenate([met, own], 1).astype(np.int32), degree, alpha)
        src, dst = np.repeat(p, degree), links[p].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        back = np.full((len(nodes), int(count.max(initial=0))), -1, np.int32)
        back[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        for a in range(0, len(nodes), 1024):
            part, more = nodes[a : a + 1024], back[a : a + 1024]
            both = np.concatenate([links[part], more], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            over = (both >= 0).sum(axis=1) > degree
            both = -np.sort(-both, axis=1)
            fit = both[~over, :degree]
            links[part[~over], : fit.shape[1]] = fit
            if over.any():
                links[part[over]] = prune(x, sq, part[over], both[over], degree, alpha)
        done += len(p)
        step = min(batch, step * 2)
    return links, entry


def nearest_vectors(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", per_shard: int = 10_000, block: int = 50_000, width: int = 192, **graph) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`, its k nearest others by inner product as the graphs find them,
    with scores in double precision, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components, and null ids, take no part; components that a vector lacks, when others are
    longer, count as zeros; with fewer than k candidates all are returned, as shards of up to `width` nodes are searched whole; rows that repeat an id and
    a vector count once; rows of the query's own id are no candidates. Equal vectors are one node with their k + 1 smallest ids. Every distinct vector is in
    one shard's graph, of about per_shard nodes, or a quarter at least where shards are too few for the cores. Graphs are built once and written to the
    shared folder. Queries go to all tasks in blocks, of 32 MB at most, and a task keeps the k nearest of all its shards, so neither queries nor graphs are copied
    in a shuffle; each block reads the graphs once."""
    v = F.col(vector_col)
    good = vectors.filter(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: c.cast("double") + 0.0).alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c)
    top = good.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"), F.coalesce(F.max(norm), F.lit(0.0)).alias("sq")).first()
    good = good.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(top.dim) - F.size("vector"))))
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    few = table(classes(good, "vector", k))
    nodes, shards = dealt(few, "vector", per_shard, tasks // 2)
    block = min(block, max(256, (4 << 20) // max(1, top.dim)))
    asked = table(good.filter(F.col("vec_id") % every == 0).distinct().withColumnRenamed("vec_id", "query_id"))
    blocks = max(1, -(-asked.count() // block))
    scale = 1 / np.sqrt(float(top.sq)) if top.sq else 1.0

    def index(side: pd.DataFrame) -> pd.DataFrame:
        exact = np.stack(side["vector"].to_list()).astype(np.float64)
        up = np.sqrt(np.maximum(0, 1 - (exact * exact).sum(axis=1) * scale * scale))
        x = np.concatenate([exact * scale, up[:, None]], 1).astype(np.float32)
        links = build(x, **graph) if len(x) > width else None
        slim = exact.astype(np.float32)
        slim = slim if (slim == exact).all() else exact
        lens = side["ids"].map(len).to_numpy(np.int64)
        return pd.DataFrame({"shard": side["shard"].iloc[:1], "index": [pickle.dumps((slim, x[:, -1], np.concatenate(side["ids"].to_list()).astype(np.int64), lens, links), 5)]})

    def search(near: np.ndarray, score: np.ndarray, index: bytes, asking: np.ndarray, want: np.ndarray) -> None:
        """The k nearest of each query so far, in near (its ids) and score (-inf: none), with those of one more shard."""
        exact, up, flat, lens, links = pickle.loads(index)
        x = np.concatenate([exact * scale, up[:, None]], 1).astype(np.float32)
        sq, first = np.einsum("id,id->i", x, x), np.cumsum(lens) - lens
        exact = exact.astype(np.float64)
        for a in range(0, len(asking), 512):
            q = np.concatenate([want[a : a + 512] * scale, np.zeros((len(asking[a : a + 512]), 1))], 1).astype(np.float32)
            met = np.tile(np.arange(len(x)), (len(q), 1)) if links is None else beam(x, sq, *links, q, max(width, k + 1))[0]
            for i, row in enumerate(met, a):
                row = row[row >= 0]
                s = (exact[row] * want[i]).sum(axis=1)
                best = s >= score[i, -1]
                row, s = row[best], s[best]
                order = np.argsort(-s, kind="stable")
                me, got, last = int(asking[i]), [], np.inf
                for r, y in zip(row[order].tolist(), s[order].tolist(), strict=True):
                    if len(got) >= k and y < last:  # all ties of the kth are in
                        break
                    got += [(-y, j) for j in flat[first[r] : first[r] + lens[r]].tolist() if j != me]
                    last = y
                if got:
                    had = np.isfinite(score[i])
                    got = sorted([*zip((-score[i][had]).tolist(), near[i][had].tolist(), strict=True), *got])[:k]
                    near[i, : len(got)], score[i, : len(got)] = [j for _, j in got], [-y for y, _ in got]

    def answers(b: int) -> DataFrame:
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        ids = rows["query_id"].to_numpy()
        held = asked.sparkSession.sparkContext.broadcast((ids, rows["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), top.dim)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asking, want = held.value
            near, score = np.zeros((len(asking), k), np.int64), np.full((len(asking), k), -np.inf)
            for rows in batches:
                for index in rows.column(0):
                    search(near, score, index.as_buffer(), asking, want)
            for a in range(0, len(asking), 5_000):
                i, j = np.nonzero(np.isfinite(score[a : a + 5_000]))
                yield pa.record_batch([pa.array(asking[a + i]), pa.array(near[a + i, j]), pa.array(score[a + i, j])], names=["query_id", "vec_id", "score"])

        return table(merged(built.select("index").coalesce(tasks).mapInArrow(run, "query_id long, vec_id long, score double"), F.desc("score"), k), 1)

    built = table(nodes.repartition(min(100_000, 2 * shards), "shard").groupBy("shard").applyInPandas(index, "shard int, index binary"))
    drop(few)
    found = reduce(DataFrame.unionAll, [answers(b) for b in range(blocks)])
    drop(built, asked)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
