"""Languages by prediction by partial matching: per-language byte context trees, frozen, give exact code lengths."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hueweave.llm.common import held, sliced, small_batches

#: Longest context, in bytes.
ORDER = 4
#: Bytes before a text, so that its first byte has a context too.
START = b" " * ORDER
#: Bytes of text that are scored at once.
CHUNK = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EIGHT = np.uint64(8)


def has_letter(t: str) -> bool:
    """Numbers other than digits, such as fractions, pass the pattern but are no letters."""
    return any(m[0].isalpha() for m in _LETTER.finditer(t))


def flat(text: str) -> bytes:
    """A text's bytes in lower case, with one space between words and one at the end, after START."""
    return START + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" "


def grams(raw: bytes) -> np.ndarray:
    """Each byte of raw from START on with the ORDER bytes before it, as one number, the byte itself lowest."""
    b = np.frombuffer(raw, np.uint8)
    out = np.zeros(len(b) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        out = out << _EIGHT | b[i : len(b) - ORDER + i]
    return out


def counted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with the sums of their counts."""
    out, at = np.unique(codes, return_inverse=True)
    return out, np.bincount(at, counts, len(out)).astype(np.int64)


def _find(sorted_: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, codes), len(sorted_) - 1)
    return at, sorted_[at] == codes


class Tree:
    """The contexts of 0 to ORDER bytes of some text, all of it, and how often each byte followed them.

    An order is an array of (context, byte) codes with counts; its nodes are the contexts, with the sum of counts, the number of different
    bytes, and, as what is excluded once a node is escaped from, the counts that its bytes have in the next shorter context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.orders = []
        for k in range(ORDER + 1):
            g, c = counted(codes & np.uint64((1 << 8 * (k + 1)) - 1), counts)
            node, first = np.unique(g >> _EIGHT, return_index=True)
            # bytes that follow a context follow its suffix too, so each is found in the order before
            below = self.orders[-1][1][np.searchsorted(self.orders[-1][0], g & np.uint64((1 << 8 * k) - 1))] if k else np.zeros(len(g), np.int64)
            self.orders.append((g, c, node, np.add.reduceat(c, first), np.diff(first, append=len(g)), np.add.reduceat(below, first)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code after the others: escapes of method C with exclusion, from the longest known context down to a uniform byte."""
        n = len(codes)
        out, done, sum_out, kinds_out = np.zeros(n), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(ORDER, -1, -1):
            g, c, node, total, kinds, below = self.orders[k]
            own = codes & np.uint64((1 << 8 * (k + 1)) - 1)
            at, known = _find(node, own >> _EIGHT)
            gram, seen = _find(g, own)
            left, different = total[at] - sum_out, kinds[at] - kinds_out
            use = known & ~done & (different > 0)
            hit = use & seen
            share = np.where(hit, c[gram], different) / np.maximum(left + different, 1)
            out[use] -= np.log2(share[use])
            done |= hit
            sum_out, kinds_out = np.where(known, below[at], sum_out), np.where(known, kinds[at], kinds_out)
        out[~done] += np.log2(256 - kinds_out[~done])
        return out


class Scorer:
    """Code lengths of texts for all languages. The lengths of grams are kept in a table of fixed size, by hash; of two that meet, the later stays."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], table_mb: int = 32):
        self.trees = [Tree(*c) for c in counts]
        size = max(10, ((table_mb << 17) // max(1, len(counts))).bit_length() - 1)
        self.shift = np.uint64(64 - size)
        self.codes = np.full(1 << size, np.uint64(1 << 63))
        self.lengths = np.zeros((1 << size, len(counts)))

    def of(self, codes: np.ndarray) -> np.ndarray:
        at = (codes * _ODD) >> self.shift
        miss = self.codes[at] != codes
        out = self.lengths[at]
        if miss.any():
            new, which = np.unique(codes[miss], return_inverse=True)
            found = np.stack([t.bits(new) for t in self.trees], 1)
            out[miss] = found[which]
            to = (new * _ODD) >> self.shift
            self.codes[to], self.lengths[to] = new, found
        return out

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the code length of the whole text, and the number of bytes."""
        total, sizes, start = np.zeros((len(texts), len(self.trees))), np.zeros(len(texts), np.int64), 0
        while start < len(texts):
            raw, end = [], start
            while end < len(texts) and (end == start or sum(map(len, raw)) < CHUNK):
                raw.append(flat(texts[end]))
                end += 1
            lens = np.array([len(r) for r in raw])
            owner = np.repeat(np.arange(len(raw)), lens)[ORDER:]
            # codes that end in the START of the next text are no one's
            owner[(np.cumsum(lens)[:-1, None] + np.arange(ORDER) - ORDER).ravel()] = len(raw)
            codes = grams(b"".join(raw))
            for a in range(0, len(codes), CHUNK):
                part, whose = self.of(codes[a : a + CHUNK]), owner[a : a + CHUNK]
                for j in range(total.shape[1]):
                    total[start:end, j] += np.bincount(whose, part[:, j], len(raw) + 1)[: len(raw)]
            sizes[start:end], start = lens - ORDER, end
        return total, sizes


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 250, longest: int = 8_000) -> tuple[list[str], list[tuple]]:
    """Languages, sorted, and the counts of their grams, from `sample` documents of each, of `longest` characters at most, by the hash of their id.

    Held-out documents, null texts and null languages teach nothing. The sample bounds what comes to the driver, two megabytes a language at most; where all
    of a language's documents are longer, these are taken instead, cut at `longest`."""
    usable = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    nth = Window.partitionBy("lang").orderBy(F.col("long"), "h", "t")
    rows = usable.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, longest).alias("t"), (F.length(text_col) > longest).alias("long"), F.xxhash64(id_col, text_col).alias("h"))
    found: dict[str, list[np.ndarray]] = {}
    for r in rows.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= sample).select("lang", "t").toLocalIterator():
        found.setdefault(r.lang, []).append(grams(flat(r.t)))
    langs = sorted(found)
    return langs, [np.unique(np.concatenate(found[x]), return_counts=True) for x in langs]


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, model: tuple | None = None, unit: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte for each row, and the columns named in keep.

    lang_pred is the language of least code length over the whole text, ties to the lower name; `und` with score 0 and null bits where the text
    is null, has no letter, or nothing was learned. score is the language's share of probability for `unit` bytes of the text's average
    kind, all languages being alike before, so it does not run to 1 with the length. No shuffle but the sample's."""
    spark = docs.sparkSession
    langs, counts = learn(docs, id_col, text_col, lang_col) if model is None else model
    shared, job, keep = spark.sparkContext.broadcast(counts), uuid.uuid4().hex, keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(job, lambda: Scorer(shared.value))
        for b in sliced(batches):
            texts = b.column(2).to_pylist()
            told = [i for i, t in enumerate(texts) if t is not None and langs and has_letter(t)]
            pred, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if told:
                bits, n = scorer.bits([texts[i] for i in told])
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(told)), best]
                share = 1 / np.exp2((least[:, None] - bits) * np.minimum(1, unit / n)[:, None]).sum(axis=1)
                for i, j, p, r in zip(told, best.tolist(), share.tolist(), (least / n).tolist(), strict=True):
                    pred[i], score[i], rate[i] = langs[j], p, r
            yield pa.record_batch([b.column(0), b.column(1), pa.array(pred), pa.array(score, pa.float64()), pa.array(rate, pa.float64()), *(b.column(3 + i) for i in range(len(keep)))], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte", *[f"__{c}" for c in keep]])

    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("own_text"), *[F.col(c).alias(f"__{c}") for c in keep])
    types = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(run, ", ".join([f"doc_id {types['doc_id']}, held_out boolean, lang_pred string, score double, bits_per_byte double", *[f"`__{c}` {types[f'__{c}']}" for c in keep]]))


def known_language(docs: DataFrame, least: float = 0.3, highest: float = 5.0, short: int = 200, text_col: str = "text", **more) -> DataFrame:
    """The rows of docs whose language is known, as they are.

    Others go: texts that are null or hold no letter, those with a score below `least`, and those of `short` bytes or more that need over
    `highest` bits a byte even in the best language, as texts in an unlearned one and gibberish do; learned ones need two to three."""
    found = small_batches(languages(docs, text_col=text_col, keep=docs.columns, **more))
    strange = (F.col("bits_per_byte") > highest) & (F.octet_length(f"__{text_col}") >= short)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least) & ~strange).select(*[F.col(f"__{c}").alias(c) for c in docs.columns])
