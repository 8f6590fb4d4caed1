"""Documents linked by the Jaccard similarity of their word n-gram sets, by vertical partitioning.

The n-grams' global order is cut into fragments. A first pass deals each set's segments to their fragments, where all
postings of an n-gram meet: what only one set holds goes, the others learn how many sets hold them. Sets too few of
whose n-grams are shared cannot link. The others meet by the rarest n-grams of their prefixes; the overlaps of such
pairs are counted in each fragment on its own and summed per pair. Equal sets are one class from the start, and pairs
within one component are never asked for, so groups of copies cost one pair for each member."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hueweave.llm.common import drop, held, release, shielded, sliced, spread_join, table, text_or_empty
from hueweave.llm.components import components

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW48 = np.uint64((1 << 48) - 1)
#: Bytes of text of a fragment: some three million n-grams.
FRAGMENT_BYTES = 14 << 20
#: Pivots of an n-gram in each round, before the pairs that are left are taken one by one. In the first the pivot of a group of near copies is the
#: same for all its n-grams, which makes the group one star; later the sets outside the component that most sets of an n-gram lie in are
#: held against so many of that component.
PIVOTS = (1, 4, 16, 64)


class Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int = 5, hashes: Words | None = None) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles, A-Z in lower case; of fewer words, one of all; of none, none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map((Words() if hashes is None else hashes).__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    g = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        g = g * _ODD + h[i : len(h) - k + 1 + i]
    return np.unique(mix(g))


def six_bytes(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def from_six(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :6] = b
    return out.view("<u8").ravel()


def _rows(by: np.ndarray, width: int, *values: np.ndarray) -> tuple[list[int], list[list[np.ndarray]]]:
    """What is to go to each destination: the destinations among by, sorted, and the slices of each of values, which are sorted by it."""
    cuts = np.flatnonzero(np.diff(by, prepend=-1, append=width + 1))
    return by[cuts[:-1]].tolist(), [[v[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)] for v in values]


def _lists(x: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array(x, pa.list_(kind))


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lens[0] numbers, then on from starts[1]."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum())) if len(lens) else np.zeros(0, np.int64)


def _cut(docs: DataFrame, fragments: int, n: int) -> DataFrame:
    """Rows to deal, in parcels: of each batch, one with the documents' classes, and for each fragment one with the segments of its classes there.

    Within a batch, a class's segments are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            hashes = held("shingles", Words)
            sets = [shingles(t, n, hashes) for t in b.column(2).to_pylist()]
            cls = np.array([int.from_bytes(hashlib.blake2b(g.tobytes(), digest_size=8).digest(), "little", signed=True) for g in sets], np.int64)
            sizes = np.array([len(g) for g in sets], np.int32)
            once = np.sort(np.unique(cls, return_index=True)[1])
            g = np.concatenate([sets[i] for i in once.tolist()]) if len(once) else np.zeros(0, np.uint64)
            owner = np.repeat(once, sizes[once])
            f = ((g >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(f, kind="stable")
            parts, (hashes, owners) = _rows(f[order], fragments, g[order], owner[order])
            runs = [np.unique(o, return_counts=True) for o in owners]
            k = len(parts)
            one = lambda x, kind: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind)), pa.nulls(k).cast(pa.list_(kind))])
            first = int(cls[0]) % fragments if len(cls) else 0
            yield pa.record_batch(
                [
                    pa.array([first, *parts], pa.int32()),
                    _lists([cls, *(cls[o] for o, _ in runs)], pa.int64()),
                    _lists([sizes, *(sizes[o] for o, _ in runs)], pa.int32()),
                    _lists([np.zeros(0, np.int32), *(c.astype(np.int32) for _, c in runs)], pa.int32()),
                    pa.array([None, *(six_bytes(x & _LOW48).tobytes() for x in hashes)], pa.binary()),
                    one(b.column(0), b.schema.field(0).type),
                    one(b.column(1), pa.int64()),
                ],
                names=["part", "cls", "n", "lens", "blob", "doc_id", "h"],
            )

    return docs.mapInArrow(run, f"part int, cls array<long>, n array<int>, lens array<int>, blob binary, doc_id array<{docs.schema['doc_id'].dataType.simpleString()}>, h array<long>")


def _all(column: pa.Array, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), kind)


def _shared(buckets: int):
    """A partition holds whole fragments: documents pass, segments keep the n-grams that several classes hold, each with a byte that grows with
    their number, in parcels by bucket of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("fragments", dict)
        mine: dict[int, list] = {}
        for b in batches:
            docs = b.filter(b.column(4).is_null())
            if docs.num_rows:
                yield pa.record_batch([docs.column(0), pa.nulls(docs.num_rows).cast(pa.int32()), *(docs.column(i) for i in range(1, 7))], names=_NAMES)
            for i, p in enumerate(b.column(0).to_pylist()):
                if b.column(4)[i].is_valid:
                    mine.setdefault(p, []).append((*(np.asarray(b.column(c)[i].values, np.int64) for c in (1, 2, 3)), b.column(4)[i].as_py()))
        for p in list(mine):
            own = mine.pop(p)
            cls, n, lens = (np.concatenate([x[i] for x in own]) for i in range(3))
            raw = np.frombuffer(b"".join(x[3] for x in own), np.uint8).reshape(-1, 6)
            del own
            first = np.zeros(len(cls), bool)
            first[np.unique(cls, return_index=True)[1]] = True
            h = from_six(raw[np.repeat(first, lens)])
            del raw
            cls, n, lens = cls[first], n[first], lens[first]
            order = np.argsort(h)
            s = h[order]
            run_ = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) - 1
            df = np.empty(len(h), np.int32)
            df[order] = np.bincount(run_)[run_]
            del order, s, run_
            keep = df > 1
            by = np.argsort(cls % buckets, kind="stable")
            place = np.empty(len(cls), np.int64)
            place[by] = np.arange(len(cls))
            at = place[np.repeat(np.arange(len(cls)), lens)[keep]]
            h, df = h[keep], df[keep]
            order = np.argsort(at, kind="stable")
            h, df = h[order], df[order]
            left = np.bincount(at, minlength=len(cls))
            raw = np.empty((len(h), 7), np.uint8)
            raw[:, :6] = six_bytes(h)
            raw[:, 6] = np.minimum(255, 4 * np.log2(np.maximum(df, 1)))
            cls, n = cls[by], n[by]
            ends = np.cumsum(left)
            some = left > 0
            to, (c, m, k, start) = _rows((cls % buckets)[some], buckets, cls[some], n[some], left[some], (ends - left)[some])
            if to:
                blobs = [raw[x[0] : x[0] + y.sum()].tobytes() for x, y in zip(start, k, strict=True)]
                none = pa.nulls(len(to))
                yield pa.record_batch([pa.array([p] * len(to), pa.int32()), pa.array(to, pa.int32()), _lists(c, pa.int64()), _lists([x.astype(np.int32) for x in m], pa.int32()), _lists([x.astype(np.int32) for x in k], pa.int32()), pa.array(blobs, pa.binary()), none.cast(b.schema.field(5).type), none.cast(b.schema.field(6).type)], names=_NAMES)
        release()

    return run


_NAMES = ["part", "bucket", "cls", "n", "lens", "blob", "doc_id", "h"]


def _sets(percent: int):
    """A partition holds whole classes: those of which enough is shared, with their segments by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[], [], [], [], []]
        for b in batches:
            lens = b.column(4)
            got[0].append(np.repeat(np.asarray(b.column(0), np.int64), np.asarray(lens.value_lengths())))
            for i, c in ((1, 2), (2, 3), (3, 4)):
                got[i].append(_all(b.column(c), np.int64))
            got[4] += b.column(5).to_pylist()
        if not got[0]:
            return
        part, cls, n, lens = (np.concatenate(x) for x in got[:4])
        raw = np.frombuffer(b"".join(got[4]), np.uint8).reshape(-1, 7)
        del got
        starts = np.cumsum(lens) - lens
        own, first, which = np.unique(cls, return_index=True, return_inverse=True)
        good = 100 * np.bincount(which, lens) >= percent * n[first]
        order = np.lexsort((part, which))
        order = order[good[which[order]]]
        to, (at,) = _rows(which[order], len(own), order)
        for a in range(0, len(to), 1000):
            c, segs = to[a : a + 1000], at[a : a + 1000]
            blobs = [raw[_ranges(starts[x], lens[x])].tobytes() for x in segs]
            yield pa.record_batch([pa.array(own[c]), pa.array(n[first][c].astype(np.int32)), _lists([part[x].astype(np.int32) for x in segs], pa.int32()), _lists([lens[x].astype(np.int32) for x in segs], pa.int32()), pa.array(blobs, pa.binary())], names=["cls", "n", "parts", "lens", "blob"])

    return run


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2_000):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for c, n, parts, lens, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                raw = np.frombuffer(blob, np.uint8).reshape(-1, 7)
                key = np.repeat(np.asarray(parts.values).astype(np.uint64), np.asarray(lens.values)) << np.uint64(48) | from_six(raw[:, :6])
                order = np.lexsort((key, raw[:, 6]))
                alone = n - len(key)
                take = n - -(-n * percent // 100) + 1 - alone
                out[0].append(key[order[:take]].view(np.int64))
                out[1].append(np.full(take, c, np.int64))
                out[2].append(np.full(take, n, np.int32))
                out[3].append(np.arange(alone, alone + take, dtype=np.int32))
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["key", "cls", "n", "at"])

    return run


_PARCEL = "part int, a array<long>, b array<long>, x array<int>, y array<int>, blob binary"
_PARCEL_NAMES = ["part", "a", "b", "x", "y", "blob"]


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of sets(cls, n, parts, lens, blob) in parcels by fragment: classes in a, lengths in x."""
    for b in sliced(batches, 2_000):
        part, lens = _all(b.column(2), np.int64), _all(b.column(3), np.int64)
        cls = np.repeat(np.asarray(b.column(0), np.int64), np.asarray(b.column(2).value_lengths()))
        raw = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, 7)
        starts = np.cumsum(lens) - lens
        order = np.argsort(part, kind="stable")
        to, (at,) = _rows(part[order], 1 << 40, order)
        none = pa.nulls(len(to))
        yield pa.record_batch([pa.array(to, pa.int32()), _lists([cls[x] for x in at], pa.int64()), none.cast(pa.list_(pa.int64())), _lists([lens[x].astype(np.int32) for x in at], pa.int32()), none.cast(pa.list_(pa.int32())), pa.array([raw[_ranges(starts[x], lens[x])].tobytes() for x in at], pa.binary())], names=_PARCEL_NAMES)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n_a, n_b, parts) in parcels by fragment, sizes in x and y."""
    for b in sliced(batches, 2_000):
        part = _all(b.column(4), np.int64)
        row = np.repeat(np.arange(b.num_rows), np.asarray(b.column(4).value_lengths()))
        order = np.argsort(part, kind="stable")
        cols = [np.asarray(b.column(i))[row[order]] for i in range(4)]
        to, (p, q, x, y) = _rows(part[order], 1 << 40, *cols)
        yield pa.record_batch([pa.array(to, pa.int32()), _lists(p, pa.int64()), _lists(q, pa.int64()), _lists(x, pa.int32()), _lists(y, pa.int32()), pa.nulls(len(to)).cast(pa.binary())], names=_PARCEL_NAMES)


def _overlaps(buckets: int):
    """A partition holds whole fragments: their segments, and pairs of classes whose common n-grams are counted there, in parcels by bucket of the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segs: dict[int, list] = {}
        pairs: dict[int, list] = {}
        for b in batches:
            for i, p in enumerate(b.column(0).to_pylist()):
                blob = b.column(5)[i].as_py()
                if blob is None:
                    pairs.setdefault(p, []).append([np.asarray(b.column(c)[i].values, np.int64) for c in (1, 2, 3, 4)])
                else:
                    segs.setdefault(p, []).append((np.asarray(b.column(1)[i].values, np.int64), np.asarray(b.column(3)[i].values, np.int64), blob))
        for p, asked in pairs.items():
            if p not in segs:
                continue
            cls, lens = (np.concatenate([x[i] for x in segs[p]]) for i in (0, 1))
            h = from_six(np.frombuffer(b"".join(x[2] for x in segs.pop(p)), np.uint8).reshape(-1, 7)[:, :6])
            rank = np.unique(h, return_inverse=True)[1].astype(np.int64)
            own = np.argsort(cls)
            place = np.empty(len(cls), np.int64)
            place[own] = np.arange(len(cls))
            codes = np.sort(np.repeat(place, lens) << 32 | rank)
            cls, lens = cls[own], lens[own]
            starts = np.cumsum(lens) - lens
            a, c, na, nc = (np.concatenate([x[i] for x in asked]) for i in range(4))
            ia, ic = np.minimum(np.searchsorted(cls, a), len(cls) - 1), np.minimum(np.searchsorted(cls, c), len(cls) - 1)
            both = np.flatnonzero((cls[ia] == a) & (cls[ic] == c))
            for lo in range(0, len(both), 20_000):
                i = both[lo : lo + 20_000]
                x, y = ia[i], ic[i]
                pair = np.repeat(np.arange(len(x)), lens[x])
                want = y[pair] << 32 | codes[_ranges(starts[x], lens[x])] & 0xFFFFFFFF
                pos = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
                common = np.bincount(pair[codes[pos] == want], minlength=len(x))
                i, common = i[common > 0], common[common > 0]
                bucket = ((a[i] ^ c[i]) >> 7) % buckets
                order = np.argsort(bucket, kind="stable")
                i = i[order]
                to, cols = _rows(bucket[order], buckets, a[i], c[i], na[i], nc[i], common[order])
                yield pa.record_batch([pa.array(to, pa.int32()), *(_lists(v, pa.int64()) for v in cols)], names=["bucket", "a", "b", "n_a", "n_b", "common"])

    return run


def _sums(percent: int):
    """A partition holds all counts of its pairs: those similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[_all(b.column(i), np.int64) for i in range(1, 6)] for b in batches]
        if not got:
            return
        a, b, na, nb, common = (np.concatenate([x[i] for x in got]) for i in range(5))
        order = np.lexsort((b, a))
        a, b, na, nb, common = a[order], b[order], na[order], nb[order], common[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        total = np.add.reduceat(common, first) if len(a) else common
        good = first[100 * total >= percent * (na[first] + nb[first] - total)]
        yield pa.record_batch([pa.array(a[good]), pa.array(b[good])], names=["u", "v"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, fragments: int, percent: int, few: bool) -> DataFrame:
    """Of pairs(a, b, n_a, n_b, by), those similar enough. by is the one of both whose fragments are asked; few: most sets are in no pair, so only those that are go to the fragments."""
    used = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    segs = (sets.join(used, "cls", "left_semi") if few else sets).select("cls", "n", "parts", "lens", "blob").mapInArrow(_send, _PARCEL)
    reach = sets.select(F.col("cls").alias("by"), "parts")
    asked = pairs.join(reach, "by").select("a", "b", "n_a", "n_b", "parts").mapInArrow(_ask, _PARCEL)
    met = segs.unionByName(asked).repartitionById(fragments, F.col("part")).mapInArrow(_overlaps(fragments), "bucket int, a array<long>, b array<long>, n_a array<long>, n_b array<long>, common array<long>")
    return met.repartitionById(fragments, F.col("bucket")).mapInArrow(_sums(percent), "u long, v long")


def _alike(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _pair(p: str, q: str) -> list[Column]:
    """a < b with their sizes."""
    low = F.col(f"{p}.cls") < F.col(f"{q}.cls")
    pick = lambda x, y, c: F.when(low, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    return [pick(p, q, "cls").alias("a"), pick(q, p, "cls").alias("b"), pick(p, q, "n").alias("n_a"), pick(q, p, "n").alias("n_b")]


#: Rows of a key on either side that one task pairs with each other.
BLOCK = 1_000


def _left_pairs(left: DataFrame, percent: int) -> DataFrame:
    """p and q from left(key, cls, n, at, component): all that may link, by blocks of a key's rows.

    The common n-grams of two sets from a key on are no more than either has left, so of the two shares n / (n - at) at least one is no more than half
    of 1 + 100 / percent. p are the rows that meet this, q all rows: sets that share a hot n-gram, but hold too much else before it, are never paired with each other."""
    light = 2 * percent * F.col("n") <= (100 + percent) * (F.col("n") - F.col("at"))
    left = left.withColumn("light", light)
    size = left.groupBy("key").agg(F.ceil(F.count_if("light") / BLOCK).cast("int").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("columns")).filter("rows > 0")
    dealt = left.join(size, "key")
    block = lambda k: F.pmod(F.xxhash64("cls", F.lit(k)), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    p = dealt.filter("light").withColumn("i", block("rows")).withColumn("j", every("columns")).drop("rows", "columns")
    q = dealt.withColumn("j", block("columns")).withColumn("i", every("rows")).drop("rows", "columns")
    p, q = p.alias("p"), q.alias("q")
    same = (F.col("p.key") == F.col("q.key")) & (F.col("p.i") == F.col("q.i")) & (F.col("p.j") == F.col("q.j"))
    return p.join(q, same & (~F.col("q.light") | (F.col("p.cls") < F.col("q.cls"))))


def linked_documents(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, classes and groups: (doc_id, h, n_shingles, cls), a row for each row of docs, h being a hash of the text; (cls, n, label, least), a row for
    each different set, with its documents; (label, n, least), a row for each group of sets that chains of similar ones link. least is a group's first document, as
    (no_id, doc_id, h): the smallest id, null last, then h.

    Exact up to collisions of hashes of about 50 bits within a pair, more where there are more fragments. Null and
    empty texts have no shingles and a null class. Ids may be null or repeat: rows count, not ids. No pairs are made
    within a component: a few rounds ask one pivot of each n-gram's sets, by size, and only then are sets that still
    lie in different components, share a prefix n-gram and are alike in size paired one by one."""
    spark = docs.sparkSession
    text = text_or_empty(F.col(text_col))
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    all_bytes = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).first().b
    fragments = max(spark.sparkContext.defaultParallelism, -(-all_bytes // FRAGMENT_BYTES))
    cut = _cut(own, fragments, n).repartitionById(fragments, F.col("part"))
    kind = own.schema["doc_id"].dataType.simpleString()
    dealt = table(cut.mapInArrow(_shared(fragments), f"part int, bucket int, cls array<long>, n array<int>, lens array<int>, blob binary, doc_id array<{kind}>, h array<long>"))
    rows = dealt.filter("bucket is null").select(F.explode(F.arrays_zip("doc_id", "h", "n", "cls")).alias("d")).select("d.doc_id", "d.h", F.col("d.n").alias("n_shingles"), F.when(F.col("d.n") > 0, F.col("d.cls")).alias("cls"))
    parcels = dealt.filter("bucket is not null").select("part", "bucket", "cls", "n", "lens", "blob")
    sets = table(parcels.repartitionById(fragments, F.col("bucket")).mapInArrow(_sets(percent), "cls long, n int, parts array<int>, lens array<int>, blob binary"))
    posts = table(sets.mapInArrow(_prefixes(percent), "key long, cls long, n int, at int"))
    tested, labels = None, None
    for r in range(len(PIVOTS) + 1):
        left = None
        now = posts if labels is None else posts.join(labels, posts.cls == labels.node, "left").drop("node")
        p = now.withColumn("component", F.col("cls") if labels is None else F.coalesce("component", "cls")).alias("p")
        if r == 0:
            # sizes within a factor of 4/3 share a band
            band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
            p = p.withColumn("band", band).alias("p")
            first = p.groupBy("key", "band").agg(F.min(F.struct("cls", "n", "at", "component")).alias("q"), F.count("*").alias("held")).filter("held > 1")
            met = p.join(first.select("key", "band", "q.*").alias("q"), ["key", "band"])
        else:
            apart = p.groupBy("key", "component").agg(F.count("*").alias("held")).groupBy("key").agg(F.max_by("component", "held").alias("most"), F.count("*").alias("apart")).filter("apart > 1")
            left = table(p.join(apart.select("key", "most"), "key"))
            if r < len(PIVOTS):
                bins = F.pmod(F.xxhash64("cls", "key", F.lit(r)), F.lit(PIVOTS[r]))
                pivots = left.filter("component = most").withColumn("bin", bins).groupBy("key", "bin").agg(F.min(F.struct("cls", "n", "at", "component")).alias("q"))
                met = left.filter("component != most").alias("p").join(pivots.select("key", "q.*").alias("q"), "key")
            else:
                met = _left_pairs(left, percent)
        shared = F.least(F.col("p.n") - F.col("p.at"), F.col("q.n") - F.col("q.at"))
        enough = shared * (100 + percent) >= percent * (F.col("p.n") + F.col("q.n"))
        pairs = met.filter((F.col("p.component") != F.col("q.component")) & _alike(F.col("p.n"), F.col("q.n"), percent) & enough)
        # a pivot is in many pairs, so the other one's fragments are asked; where there is no pivot, either one's
        by = F.when(F.pmod(F.xxhash64("p.cls", "q.cls"), F.lit(2)) == 0, F.col("q.cls")).otherwise(F.col("p.cls")) if r == len(PIVOTS) else F.col("p.cls")
        pairs = pairs.select(*_pair("p", "q"), by.alias("by")).groupBy("a", "b", "n_a", "n_b").agg(F.min("by").alias("by"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = table(pairs)
        if not pairs.take(1):
            drop(left, pairs)
            continue
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        found = table(_linked(pairs, sets, fragments, percent, r > 0))
        stars = found if labels is None else found.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v")))
        labels = components(stars)
        drop(left, found)
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first"))
    classes = classes.withColumn("label", F.col("cls")) if labels is None else classes.join(labels, classes.cls == labels.node, "left").withColumn("label", F.coalesce("component", "cls")).drop("node", "component")
    classes = table(classes)
    groups = table(classes.groupBy("label").agg(F.count("*").alias("n"), F.min("first").alias("least")))
    named = table(spread_join(classes.select("cls", "label", F.col("n").alias("held")), groups, "label", "cls", classes.count()).withColumnRenamed("held", "n"))
    drop(sets, posts, classes)
    return rows, named, groups


def similar_components(docs: DataFrame, **more) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach, the document's own included."""
    rows, named, _ = linked_documents(docs, **more)
    found = spread_join(rows, named.select("cls", "n", "least"), "cls", "doc_id", rows.count(), "left")
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"))


@shielded
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs, of each group of linked ones only that of the smallest id (null last), then text hash; documents without words stay."""
    _, _, groups = linked_documents(docs, id_col=id_col, text_col=text_col, **more)
    keep = groups.select(F.col("least.doc_id").alias("__id"), F.col("least.h").alias("__h"))
    marked = docs.withColumn("__h", F.xxhash64(text_or_empty(F.col(text_col))))
    empty = F.length(F.regexp_replace(text_or_empty(F.col(text_col)), r"[\x20\x09-\x0D]+", "")) == 0
    held = marked.filter(~empty).join(keep.withColumnRenamed("__h", "__kept"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__kept")))
    once = held.dropDuplicates(["__id", "__kept"])
    return once.select(*docs.columns).unionByName(marked.filter(empty).select(*docs.columns))
