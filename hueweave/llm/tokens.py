"""Token counts and ids of whole texts by white-space chunks, whose ids worker caches keep; counts begin with a broadcast table of frequent ones.

The tokenizer drops white space and none of its pieces crosses it, so a text's ids are its chunks' ids in a row."""

from __future__ import annotations

import os
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.llm.common import held, release, sliced, text_or_empty

#: Characters at which str.split cuts but the tokenizer does not; texts that hold one are encoded whole.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: After a word, one of these is a piece of its own.
MARKS = frozenset(".,;:!?")
#: Longer chunks are encoded but never kept.
LONGEST = 48
_TOKENIZERS: dict = {}
_BARE: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def ids_of(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def _bare(path: str):
    """The tokenizer's model alone on white-space pieces, the characters that stand for bytes, and which ids end a piece.

    Printable bytes stand for themselves, the others for characters from 256 on; a space stays."""
    if path not in _BARE:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        bare = Tokenizer(tokenizer(path).model)
        bare.pre_tokenizer = WhitespaceSplit()
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        chars = {b: chr(256 + i) for i, b in enumerate(odd) if b != 32}
        vocabulary = tokenizer(path).get_vocab(True)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        _BARE[path] = bare, chars, ends
    return _BARE[path]


def simple_ids(path: str, words: list[str]) -> list[bytes]:
    """ids_of for words of letters, which may end in one of MARKS, a piece of its own.

    Letters need no cutting, so normal form, lower case and bytes are done for all at once, and the model is asked directly.
    A piece's last token, and no other, ends a word, which tells the words apart. Letters whose lower case is not one letter, or depends on the place, and texts that
    are not in normal form go the long way, as they are."""
    marked = [w[-1] in MARKS for w in words]
    text = " ".join([f"{w[:-1]} {w[-1]}" if m else w for w, m in zip(words, marked, strict=True)])
    bare, chars, ends = _bare(path)
    if is_normalized("NFC", text) and not any(c in text for c in "\u0130\u03a3"):
        ids = np.asarray(bare.encode_batch_fast([text.lower().encode().decode("latin-1").translate(chars)], add_special_tokens=False)[0].ids, "<u4")
        at, last = np.flatnonzero(ends[ids]), np.cumsum(np.asarray(marked) + 1)
        if len(at) == last[-1]:
            cuts, raw = ((at[last - 1] + 1) * 4).tolist(), ids.tobytes()
            return [raw[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]
    return ids_of(path, words)


class Chunks:
    """Values of chunks. Known ones start with the frequent table and grow to `keep` entries, then start anew."""

    def __init__(self, path: str, frequent: dict, make, keep: int):
        self.path, self.frequent, self.make, self.keep = path, frequent, make, keep
        self.known = dict(frequent)

    def values(self, texts: list[str]) -> Iterator:
        """The chunks' values of each text, in order; a text that holds NOT_SPACE has one, its own."""
        split = [[t] if any(c in t for c in NOT_SPACE) else t.split() for t in texts]
        new = set().union(*split).difference(self.known)
        known, simple, other = self.known, [], []
        for w in new:
            (simple if w.isalpha() or w[-1:] in MARKS and w[:-1].isalpha() else other).append(w)
        if simple:
            known.update(zip(simple, map(self.make, simple_ids(self.path, simple)), strict=True))
        if other:
            known.update(zip(other, map(self.make, ids_of(self.path, other)), strict=True))
        for chunks in split:
            yield map(known.__getitem__, chunks)
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        if len(known) > self.keep:
            self.known = dict(self.frequent)


def _chunks(path: str, frequent, job: str, make, keep: int) -> Chunks:
    """One cache for each worker process and job; workers are reused from task to task. frequent is a broadcast, or None: the cache begins empty."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held((path, make.__name__, job), lambda: Chunks(path, {w: make(b) for w, b in frequent.value.items()} if frequent else {}, make, keep))


def count(ids: bytes) -> int:
    return len(ids) >> 2


def same(ids: bytes) -> bytes:
    return ids


def frequent_chunks(docs: DataFrame, path: str, text_col: str, held_chunks: int = 200_000, of_each: int = 4_096, entries: int = 1 << 16) -> dict[str, bytes]:
    """Ids of the most frequent chunks of the whole table: at most `entries`, each of LONGEST characters at most.

    Each task counts in a table of held_chunks, whose rarer half goes when it is full, and tells its of_each most frequent ones, which are then summed.
    The table only saves time: no result depends on what is in it. Ties go to the lower chunk, equal sums of other tasks aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                found.update(t.split())
                if len(found) > held_chunks:
                    found = Counter(dict(found.most_common(held_chunks // 2)))
        top = [(w, n) for w, n in found.most_common(of_each) if len(w) <= LONGEST]
        yield pa.record_batch([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["chunk", "n"])

    counts = docs.filter(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    top = [r.chunk for r in counts.orderBy(F.desc("n"), "chunk").limit(entries).select("chunk").collect()]
    out = dict(zip(top, ids_of(path, top), strict=True)) if top else {}
    _TOKENIZERS.pop(path, None)  # the driver needs it no more
    release()
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, keep: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; null texts count as empty. No shuffle.

    Special strings inside a text are taken as the library takes them by default."""
    spark = docs.sparkSession
    frequent, job = spark.sparkContext.broadcast(frequent_chunks(docs, path, text_col)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(path, frequent, job, count, keep)
        for b in sliced(batches):
            n = [sum(v) for v in chunks.values(b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty(F.col(text_col))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def binary_pieces(n: int, top: int) -> list[int]:
    """Lengths of a document's pieces: as many of `top` as fit, then the powers of two of the rest, falling."""
    return [top] * (n // top) + [1 << k for k in range(top.bit_length() - 1, -1, -1) if n % top >> k & 1]


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, top: int = 4096, keep: int = 1_000_000, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset (and ids, as bytes).

    A document, with end_id at its end, is cut at falling powers of two; each piece is a sequence of its own, whose
    length is a power of two, so no sequence crosses documents and none has padding. bucket is the power: batches
    draw from one bucket. sequence_id holds partition and place, so it is unique and needs no shuffle.
    Null texts are empty: one piece of one token. top is a power of two. The texts are read once: chunks are not counted
    beforehand, each worker encodes a frequent one when it first meets it."""
    job = uuid.uuid4().hex
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(path, None, job, same, keep)
        for b in sliced(batches, 200):
            row, start, length, crc, tokens, held = [], [], [], [], [], []
            for k, v in enumerate(chunks.values(b.column(1).to_pylist())):
                ids = b"".join(v) + end
                at = 0
                for m in binary_pieces(n := len(ids) >> 2, top):
                    piece = ids[at * 4 : (at + m) * 4]
                    row.append(k)
                    start.append(at)
                    length.append(m)
                    crc.append(zlib.crc32(piece))
                    tokens.append(n)
                    if with_ids:
                        held.append(piece)
                    at += m
            cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            yield pa.record_batch([*cols, pa.array(held, pa.binary())] if with_ids else cols, names=[*NAMES, "ids"] if with_ids else NAMES)

    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    out = own.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)
    return out.withColumns({"bucket": F.round(F.log2("length")).cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
