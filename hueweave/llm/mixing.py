"""Sources mixed to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hueweave.llm.common import WORD, shielded, table, text_or_empty

#: Fractional parts of the golden ratio times 1 and times 2^20.
STEP, LEAP = 0.6180339887498949, (0x9E3779B97F4A7C15 * (1 << 20) % (1 << 64)) / float(1 << 64)
#: Cells of [0, 1) by which points meet sources, and slots of a chunk.
GRID, CHUNK = 4096, 8192


def _key(source: str | Column) -> Column:
    source = F.col(source) if isinstance(source, str) else source
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


#: Bits of the hash by which a source's documents are in a row.
BITS = 60


def place(id_col: str, text: Column) -> Column:
    """A document's place among its source's: the first BITS of the MD5 of id and text."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text)), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(key, source, source_size) with target.

    Sources in code point order, null last, take the weights in turn and share `share` times all words; none gets
    more than `most` times its own, and what is above goes to the others by weight. Sorted by the level at which
    they reach their cap, the capped sources are those whose level is not above that of the rest. One row per source,
    so these windows over the whole line see few rows."""
    line = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(line) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1))
    s = s.withColumns({"cap": F.lit(float(most)) * F.col("source_size")}).withColumn("level", F.col("cap") / F.col("w"))
    whole = Window.partitionBy()
    by_level = Window.orderBy("level", "key")
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"goal": F.lit(float(share)) * F.sum("source_size").over(whole), "all_w": F.sum("w").over(whole), "cap_b": F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)), "w_b": F.coalesce(F.sum("w").over(earlier), F.lit(0.0))})
    s = s.withColumn("rest", (F.col("goal") - F.col("cap_b")) / (F.col("all_w") - F.col("w_b"))).withColumn("full", F.col("level") <= F.col("rest"))
    rate = F.min(F.when(~F.col("full"), F.struct("level", "key", "rest"))).over(whole)["rest"]
    return s.withColumn("rate", rate).select("key", "source", "source_size", "w", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("rate")).alias("target"))


def schedule(aims: DataFrame, block: int) -> DataFrame:
    """slot, key, rank: the order in which blocks of sources come; aims has key and words, a whole number.

    Point i is the fraction of i times the golden ratio; its place among the cumulative shares names the source,
    and slots of a source are ranked by i. A source gets as many slots as its words have blocks: surplus
    ranks are left out, and missing ones (a few for each source, as the points are even) follow at the end."""
    spark = aims.sparkSession
    line = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    a = aims.filter("words > 0").withColumn("need", F.ceil(F.col("words") / block).cast("long"))
    a = a.withColumns({"all": F.sum("words").over(Window.partitionBy()), "b": F.coalesce(F.sum("words").over(line), F.lit(0))})
    a = table(a.select("key", "need", (F.col("b") / F.col("all")).alias("lo"), ((F.col("b") + F.col("words")) / F.col("all")).alias("hi")))
    n = a.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("n")).first().n
    cells = a.select("key", "need", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)))).alias("cell"))
    i = F.col("id")
    x = F.shiftright(i, 20) * F.lit(LEAP) % 1.0 + F.col("id") % (1 << 20) * F.lit(STEP)
    points = spark.range(n).select("id", (x % 1.0).alias("u")).withColumn("cell", F.floor(F.col("u") * GRID))
    drawn = points.join(cells, "cell").filter("u >= lo and (u < hi or hi = 1.0)").select("id", "key", "need", F.floor(i / CHUNK).alias("chunk"))
    counts = table(drawn.groupBy("key", "chunk").agg(F.count("*").alias("n")))
    before = counts.select("key", "chunk", (F.sum("n").over(Window.partitionBy("key").orderBy("chunk")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("key", "chunk").orderBy("id")) - 1
    ranked = drawn.join(before, ["key", "chunk"]).select(i.alias("slot"), "key", rank.alias("rank"), "need").filter("rank < need").select("slot", "key", "rank")
    short = a.join(counts.groupBy("key").agg(F.sum("n").alias("got")), "key", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    tail = short.select("key", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    return ranked.unionByName(tail.select((F.lit(n) + F.col("rank")).alias("slot"), "key", "rank"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per piece of the mix: doc_id, h, row, size, source_size, target, slot, first (the piece's first word in the document) and words.

    Each source's documents, in the order of a hash of id and text, form a stream of words that is read round and round
    until floor(target) words are taken; it is cut into blocks of `block` words, which the schedule's slots take by
    rank. A document that the mix leaves out has one row with null slot and no words. Null texts are empty; null sources
    are one source, the last; equal rows are counted first and told apart by `row` once they have their places. No step puts a source in one task: a source's
    stream is summed by ranges of the hash first. Only sums of whole sources, a row each, meet in one task."""
    text = text_or_empty(F.col(text_col))
    slim = table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), place(id_col, text).alias("h")).withColumn("key", _key("source")))
    n = slim.count()
    bits = max(6, (n // 5_000).bit_length())
    slim = slim.withColumn("bucket", F.shiftright("h", BITS - bits))
    sums = table(slim.groupBy("key", "source", "bucket").agg(F.sum("size").alias("b_size")))
    aims = table(targets(sums.groupBy("key", "source").agg(F.sum("b_size").alias("source_size")), weights, share, most).withColumn("words", F.least(F.floor(F.col("target") + 1e-6), F.floor(F.lit(most) * F.col("source_size"))).cast("long")))
    start = F.sum("b_size").over(Window.partitionBy("key").orderBy("bucket")) - F.col("b_size")
    ranges = sums.select("key", "bucket", start.alias("start")).join(aims.select("key", "source_size", "target", "words"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    equal = slim.groupBy("key", "bucket", "h", "doc_id", "size").agg(F.count("*").alias("n"))
    equal = equal.withColumn("at", F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n")).join(ranges, ["key", "bucket"])
    each = equal.withColumn("lot", F.explode(F.expr("sequence(0L, (n - 1) div 65536)"))).withColumn("row", F.explode(F.expr("sequence(lot * 65536, least(n - 1, lot * 65536 + 65535))")))
    placed = each.withColumn("at", F.col("start") + F.col("at") + F.col("row") * F.col("size"))
    laps = F.when((F.col("words") > F.col("at")) & (F.col("size") > 0), F.ceil((F.col("words") - F.col("at")) / F.col("source_size")).cast("int")).otherwise(0)
    spans = F.expr(f"flatten(transform(if(laps > 0, sequence(0, laps - 1), cast(array() as array<int>)), l -> transform(sequence((at + l * source_size) div {block}, (least(at + size + l * source_size, words) - 1) div {block}), r -> struct(l as lap, r as rank))))")
    cut = placed.withColumn("laps", laps).withColumn("span", F.explode_outer(spans)).select("doc_id", "key", "h", "bucket", "row", "size", "source_size", "target", "words", "at", F.col("span.rank").alias("rank"), F.col("span.lap").alias("lap"))
    low = F.greatest(F.col("rank") * block, F.col("at") + F.col("lap") * F.col("source_size"))
    high = F.least((F.col("rank") + 1) * block, F.col("at") + F.col("size") + F.col("lap") * F.col("source_size"), F.col("words"))
    slots = schedule(aims.select("key", "words"), block)
    held = cut.join(slots, ["key", "rank"], "left")
    return held.select("doc_id", "key", "h", "bucket", "row", "size", "source_size", "target", "slot", (low - F.col("at") - F.col("lap") * F.col("source_size")).alias("first"), F.when(F.col("slot").isNotNull(), high - low).otherwise(0).alias("taken"))


def mixed_documents(docs: DataFrame, **more) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs. See mixture."""
    pieces = mixture(docs, **more)
    return pieces.groupBy("doc_id", "key", "h", "bucket", "row", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).select("doc_id", "key", "h", "size", "source_size", "target", "taken")


@shielded
def mixed_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", width: int = 8_192, **more) -> DataFrame:
    """The pieces of the mix as rows of docs, in slot order: texts are the pieces' words, with the white space before them, and chars_col their length.

    A document comes as often as blocks of the schedule take from it, so a source has its target to the word. Partitions are
    ranges of `width` slots, rising, each sorted, so files in the order of their names hold the schedule's order. Rows of equal id,
    text and source share their pieces, and the other columns of one of them."""
    pieces = mixture(docs, id_col=id_col, text_col=text_col, source_col=source_col, **more).filter("taken > 0")
    pieces = table(pieces.select(F.col("key").alias("__key"), F.col("h").alias("__h"), F.col("slot").alias("__slot"), F.col("first").alias("__first"), F.col("taken").alias("__taken")))
    last = pieces.agg(F.coalesce(F.max("__slot"), F.lit(0)).alias("s")).first().s
    text = text_or_empty(F.col(text_col))
    own = docs.withColumns({"__h": place(id_col, text), "__key": _key(F.col(source_col).cast("string"))}).dropDuplicates(["__key", "__h"])
    lists = pieces.groupBy("__key", "__h").agg(F.collect_list(F.struct("__slot", "__first", "__taken")).alias("__pieces"))
    # words are split before the pieces are dealt out, once a document
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = own.join(lists, ["__key", "__h"]).withColumn("__words", words).withColumn("__piece", F.explode("__pieces"))
    piece = F.array_join(F.slice("__words", F.col("__piece.__first").cast("int") + 1, F.col("__piece.__taken").cast("int")), "")
    cut = cut.withColumns({"__slot": F.col("__piece.__slot"), "__first": F.col("__piece.__first"), "__text": piece})
    new = {text_col: F.col("__text"), chars_col: F.length("__text").cast("long")}
    cut = cut.select("__slot", "__first", *[(new[c] if c in new else F.col(c)).alias(c) for c in docs.columns])
    dealt = cut.repartitionById(int(last // width) + 1, F.floor(F.col("__slot") / width).cast("int"))
    return dealt.sortWithinPartitions("__slot", id_col, "__first").select(*docs.columns)
