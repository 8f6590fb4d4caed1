"""What both vector searches share: distinct keys with their smallest ids, shards of them, and results merged by query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null or zero, and no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, key: str, k: int) -> DataFrame:
    """key and ids: the k + 1 smallest ids of the rows that share a key.

    These are all that a k nearest search needs of equal rows, with one to spare for the query's own; row numbers
    are limited before the shuffle, so a key that a third of all rows share moves k + 1 rows of each partition."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("vec_id"))
    few = rows.select("vec_id", key).distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    return few.groupBy(key).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def dealt(classes_: DataFrame, key: str, per_shard: int, cores: int = 1) -> tuple[DataFrame, int]:
    """classes_ with shard, by a hash of the key, and the number of shards: one for each per_shard rows, or up to `cores` of a quarter of that."""
    rows = classes_.count()
    n = max(1, -(-rows // per_shard), min(cores, -(-4 * rows // per_shard)))
    return classes_.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def asked(queries: DataFrame, shards: int, block: int) -> tuple[DataFrame, int]:
    """queries(query_id, ...) for each shard, in blocks of about `block` queries; smaller ones, of 64 at least, where shards are too few to keep the cores busy."""
    n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(-(-n // 64), -(-2 * cores // shards)))
    q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))), blocks


def cells(sides: DataFrame, queries: DataFrame, shards: int, blocks: int, search: Callable, schema: str) -> DataFrame:
    """search(side, queries) for every shard and block. The number of partitions is given, as adaptive plans would join small ones into a single task."""
    deal = lambda df: df.repartition(min(100_000, 2 * shards * blocks), "shard", "block").groupBy("shard", "block")
    sides = sides.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return deal(sides).cogroup(deal(queries)).applyInPandas(search, schema)


def merged(found: DataFrame, measure: Column, k: int) -> DataFrame:
    """Of (query_id, vec_id, ...), each query's k first by measure, ties to the smaller id, with rank from 1."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(measure, "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
