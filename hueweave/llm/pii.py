"""Personal data: patterns with checks, and terms that disclose a protected entity by co-occurrence over the corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hueweave.llm.common import drop, shielded, sliced, small_batches, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
# A run's start is the only place where a match can start, so runs are taken whole and never tried again from within.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"\b[^\W\d_]{3,}\b")
_WORD_CHAR = re.compile(r"\w")
#: Rows of a batch that tasks make.
ROWS = 100_000
#: One text in so many, by its hash, tells which terms are too frequent before all texts are counted.
PART = 16
#: Bits, as a power of two, of a map of hashes that all tasks hold: two megabytes.
MARKS = 24


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """The local part is the whole run before an @, from the end of the last match on."""
    free, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > free and t[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at)):
            yield start, m.end()
            free = m.end()
            at = t.find("@", free)
        else:
            free = at + 1
            at = t.find("@", at + 1)


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of emails, ips, cards and phones, by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(t)] if "@" in t else []
    if _DIGIT.search(t):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(t):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in t:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    out.sort()
    return out


def _entity(t: str, span: tuple[int, int, int]) -> str:
    s, k, e = span
    return f"{KINDS[k]}:{t[s:e].lower() if k == 0 else re.sub('[^0-9.]' if k == 1 else '[^0-9]', '', t[s:e])}"


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def words_beside(t: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """The different terms of a text in lower case, without those that overlap its base spans."""
    out, at = [], 0
    for s, _, e in spans:
        if e > at:
            s = max(s, at)
            out += [t[at:s], _WORD_CHAR.sub("0", t[s:e])]
            at = e
    return {x.lower() for x in set(_TERM.findall("".join([*out, t[at:]])))}


def entities(t: str, spans: list[tuple[int, int, int]]) -> set[int]:
    return {_hash(_entity(t, x)) for x in spans}


def contexts(t: str, wanted: Callable[[int], bool] | None = None) -> Iterator[tuple[int, str]]:
    """(entity, term) for the different entities of a text, or the wanted ones of them, and all its terms."""
    spans = base_spans(t)
    own = entities(t, spans) if spans else set()
    own = own if wanted is None else set(filter(wanted, own))
    if own:
        terms = words_beside(t, spans)
        yield from ((e, x) for e in own for x in terms)


def term_hash(term: str) -> int:
    """xxhash64 of Spark."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)


def _marked(hashes: DataFrame) -> Callable[[int], bool]:
    """Whether a number may be among those of the one column of hashes: true for all that are, and for few others. A map of 2**MARKS bits, which all tasks hold, whatever the number of hashes."""
    h = F.col(hashes.columns[0]).bitwiseAND((1 << MARKS) - 1)
    words = np.zeros(1 << MARKS - 6, np.int64)
    for r in hashes.groupBy(F.shiftright(h, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({hashes.columns[0]} & 63 as int))")).alias("bits")).toLocalIterator():
        words[r["at"]] = r["bits"]
    shared = hashes.sparkSession.sparkContext.broadcast(words.view(np.uint8).tobytes())
    return lambda x: bool(shared.value[(x & (1 << MARKS) - 1) >> 3] >> (x & 7) & 1)


def _words(texts: DataFrame, wanted: Callable[[str], bool]) -> DataFrame:
    """term, around of the wanted terms of texts(text, around)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [(x, h) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in words_beside(t, base_spans(t)) if wanted(x)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "around"])

    return texts.mapInArrow(run, "term string, around long")


def disclosing_terms(docs: DataFrame, text_col: str = "text", threshold: float = 0.9, support: int = 5, held_terms: int = 200_000) -> DataFrame:
    """term: those whose pointwise mutual information with a protected entity is at least `threshold` of the entity's information.

    Entities are the base values; an entity and a term co-occur where a text holds both, however far apart. n(e, t) counts
    different texts that hold both, n(e) those that hold e, n(t) those that hold t, n all, over the whole table, so copies of
    a text count once; pairs of fewer than `support` texts tell nothing (in a corpus, what stands once beside a value that stands once would seem to disclose it),
    so entities of fewer are not paired: all tasks hold a map of bits of those that have support, and what passes it by chance goes in a join. All counts are sums
    by key with partial aggregation, so a frequent entity or term does not meet in one task. Texts are counted for terms of enough support: up to `held_terms` of
    them by a set that all tasks hold, more by a map of bits and a join, with the same result."""
    spark = docs.sparkSession

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [(e, h) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for e in entities(t, base_spans(t))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["entity", "around"])

    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("around")).filter("text is not null")
    likely = texts.filter(F.col("text").rlike("[0-9@]"))
    alone = table(likely.mapInArrow(named, "entity long, around long").distinct().groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support))
    if not alone.take(1):
        return spark.createDataFrame([], "term string")
    supported = _marked(alone.select("entity"))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = contexts(t, supported)
                while some := list(islice(rows, ROWS)):
                    yield pa.record_batch([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.string()), pa.array([h] * len(some), pa.int64())], names=["entity", "term", "around"])

    near = table(likely.mapInArrow(paired, "entity long, term string, around long").distinct())
    hashes = table(texts.groupBy("around").agg(F.count("*").alias("copies")))
    n = hashes.count()
    pmi = F.log2(F.col("n_et") * n / (F.col("n_e") * F.greatest("n_t", "n_et")))
    enough = pmi >= threshold * F.log2(F.lit(float(n)) / F.col("n_e"))
    # texts of paired entities that hold a term are some of those that hold it, so what fails by them would fail by all
    some = near.groupBy("term", "around").agg(F.lit(1)).groupBy("term").agg(F.count("*").alias("n_t"))
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support)
    pairs = table(pairs.join(alone, "entity").join(some, "term").filter(enough).drop("n_t"))
    drop(near, alone)
    # so would what fails by one text in PART
    wanted = pairs.select("term").distinct()
    part = texts.filter(F.pmod(F.shiftright("around", 8), F.lit(PART)) == 0).dropDuplicates(["around"])
    among = _marked(wanted.select(F.xxhash64("term").alias("h")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                found.update(x for x in words_beside(t, base_spans(t)) if among(term_hash(x)))
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    held_there = part.select("text").mapInArrow(sums, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    fewer = table(pairs.join(held_there, "term", "left").withColumn("n_t", F.coalesce("n_t", F.lit(0))).filter(enough).drop("n_t"))
    drop(pairs)
    pairs, wanted = fewer, fewer.select("term").distinct()
    n_terms = wanted.count()
    if not n_terms:
        return pairs.select("term").limit(0)
    repeated = _marked(hashes.filter("copies > 1").select("around"))
    drop(hashes)
    if n_terms <= held_terms:
        held = spark.sparkContext.broadcast(frozenset(r.term for r in wanted.toLocalIterator()))

        def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for b in sliced(batches):
                row: list[tuple[list[str], int]] = []
                for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if terms := held.value & words_beside(t, base_spans(t)):
                        if repeated(h):
                            row.append((sorted(terms), h))
                        else:
                            found.update(terms)
                yield pa.record_batch([pa.array([r[0] for r in row], pa.list_(pa.string())), pa.array([r[1] for r in row], pa.int64()), pa.array([1] * len(row), pa.int64())], names=["terms", "around", "n"])
            yield pa.record_batch([pa.array([[x] for x in found], pa.list_(pa.string())), pa.nulls(len(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["terms", "around", "n"])

        counts = texts.mapInArrow(hold, "terms array<string>, around long, n long")
    else:
        among = _marked(wanted.select(F.xxhash64("term").alias("h")))
        counts = _words(texts, lambda x: among(term_hash(x))).join(wanted, "term", "left_semi").select(F.array("term").alias("terms"), "around", F.lit(1).alias("n"))
    # rows without a text are sums over texts that stand once; of one that may be repeated, one row counts
    counts = counts.groupBy("terms", "around").agg(F.sum("n").alias("n")).select(F.explode("terms").alias("term"), F.when(F.col("around").isNull(), F.col("n")).otherwise(1).alias("n"))
    n_t = counts.groupBy("term").agg(F.sum("n").alias("n_t"))
    out = table(pairs.join(n_t, "term").filter(enough).select("term").distinct())
    drop(pairs)
    return out


def term_spans(t: str, terms: frozenset) -> list[tuple[int, int, int]]:
    """Whole words among terms, in any case; words that lie in a base span stay with it."""
    return [(m.start(), 4, m.end()) for m in _TERM.finditer(t) if m[0].lower() in terms]


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def sanitised(t: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span generalised to its kind in brackets, terms to [TERM]; what overlaps an earlier span goes with it."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [t[at:s], f"[{KINDS[k].upper()}]"]
        elif e > at:
            out.append("")
        at = max(at, e)
    return "".join([*out, t[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, most: int = 100_000, keep: list[str] | None = None, **corpus) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, text (sanitised): one row for each row of docs.

    keep names further columns to carry. Null texts count as empty and come back empty. terms: see disclosing_terms, which is
    asked by default. Up to `most` terms are broadcast; of more, each text's own are found by a map of bits and a join, and joined with the text."""
    spark = docs.sparkSession
    found = disclosing_terms(docs, text_col, **corpus) if terms is None else terms
    keep = keep or []
    own = docs.select(F.col(id_col).alias("__id"), text_or_empty(F.col(text_col)).alias("__text"), *[F.col(c) for c in keep])
    types = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join([f"`__id` {types['__id']}", "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, `__text` string", *[f"`{c}` {types[c]}" for c in keep]])
    if few := found.count() <= most:
        held = spark.sparkContext.broadcast(frozenset(r.term for r in found.toLocalIterator()))
    else:
        among = _marked(found.select(F.xxhash64("term").alias("h")))
        texts = own.select(F.col("__text").alias("text"), F.xxhash64("__text").alias("around"))
        hits = _words(texts, lambda x: among(term_hash(x))).distinct().join(found, "term", "left_semi").groupBy("around").agg(F.collect_list("term").alias("__terms"))
        own = own.withColumn("__around", F.xxhash64("__text")).join(hits.withColumnRenamed("around", "__around"), "__around", "left").select("__id", "__text", *keep, "__terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            counts, sha, all_, text = [[], [], [], []], [], [], []
            own_terms = [held.value] * b.num_rows if few else [frozenset(x or ()) for x in b.column(2 + len(keep)).to_pylist()]
            for t, some in zip(b.column(1).to_pylist(), own_terms, strict=True):
                base = base_spans(t)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(told(base).encode()).hexdigest())
                more = term_spans(t, some) if some else []
                more = [x for x in more if not any(s < x[2] and x[0] < e for s, _, e in base)] if base else more
                spans = sorted(base + more)
                all_.append(told(spans))
                text.append(sanitised(t, spans) if spans else t)
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(all_, pa.string()), pa.array(text, pa.string()), *(b.column(2 + i) for i in range(len(keep)))]
            yield pa.record_batch(cols, names=["__id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "__text", *keep])

    return own.mapInArrow(run, schema)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """find without the text, for digests."""
    return find(docs, id_col, text_col, **more).select(F.col("__id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@shielded
def sanitised_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **more) -> DataFrame:
    """docs with sanitised texts and, if there is one, the count of characters; null texts stay null."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    marked = docs.withColumn("__null", F.col(text_col).isNull())
    out = small_batches(find(marked, id_col, text_col, keep=[*rest, "__null"], **more))
    text = F.when(F.col("__null"), F.lit(None)).otherwise(F.col("__text"))
    new = {id_col: F.col("__id"), text_col: text, chars_col: F.length(text).cast("long")}
    return out.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in docs.columns])


def information(n_et: int, n_e: int, n_t: int, n: int) -> float:
    """The share of an entity's information that a term gives."""
    return math.log2(n_et * n / (n_e * n_t)) / math.log2(n / n_e)
