"""The ten operators against brute force, on a small table of awkward rows: nulls, empty and very long texts, ties, copies, clashing columns."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hueweave.llm import vectors as vectors_module
from hueweave.llm import common, graph, hamming, jaccard, language, mixing, pii, queries, sharding, tokens, urls

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label string, size int, part int, row int, h long, key string, cls long"


def texts():
    r = random.Random(1)
    base = [" ".join(r.choice("red green blue cyan gold grey pink teal".split()) + str(r.randrange(30)) for _ in range(60)) for _ in range(6)]
    near = [b.replace(b.split()[7], "X") for b in base] + [" ".join(b.split()[:50]) for b in base]
    odd = [None, "", " \t\n", "a", "A b", "a B", "one two three four", "!!! 123", "½ ² 3", "x" * 30_000, " ".join(["word"] * 9_000), base[0], base[0], base[0].upper(), "Mail a.b@c.de, +1 (555) 123-4567; 4111 1111 1111 1111 1.2.3.4 999.1.1.1 x@y z@q.r@s.t", "İstanbul ΣΑΣ don't <|endoftext|> é\x1cz 12½"]
    return base + near + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 9 else None, t, "en" if i % 2 else "de", ("b", "a", None, "c")[i % 4], None, "l", 1, 2, 3, 4, "k", 5) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[-1]], COLUMNS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def numbered(docs):
    return docs.filter("doc_id is not null").dropDuplicates(["doc_id"])


def sets_of(rows):
    out = {}
    for r in rows:
        w = WORD.findall((r.text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
        out[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def groups(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_jaccard(spark, docs, empty):
    for own in (numbered(docs), spark.read.parquet(f"{D}/documents.parquet").limit(120)):
        rows = own.collect()
        sets = sets_of(rows)
        want = groups(sets)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(own).collect()}
        assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert jaccard.similar_components(docs).count() == docs.count()
    assert jaccard.similar_components(empty).count() == 0


def test_jaccard_chains_need_the_pairs_that_pivots_miss(spark):
    """A chain of windows over one line of words: neighbours link, others do not, and pivots alone cannot tell."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(40)]
    got = {r.component_id for r in jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_jaccard_with_hot_n_grams(spark):
    """Sets that share one passage, as much of them as must be paired one by one, in blocks of few rows; and many copies, repeated and null ids."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [" ".join([*[f"u{i}_{j}" for j in range(r.choice((0, 2, 9, 12, 14, 30)))], *passage[r.randrange(4) :], f"v{i}"]) for i in range(70)] + [" ".join(passage)] * 30
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    before, jaccard.BLOCK, pivots, jaccard.PIVOTS = jaccard.BLOCK, 5, jaccard.PIVOTS, (1,)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(d).collect()}
        kept = {r.doc_id for r in jaccard.one_of_each(d.withColumn("doc_id", F.when(F.col("doc_id") < 95, F.col("doc_id")))).collect()}
    finally:
        jaccard.BLOCK, jaccard.PIVOTS = before, pivots
    sets = sets_of(d.collect())
    want = groups(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert kept == {i for i, c in want.items() if i == c}


def test_one_of_each(spark, docs):
    own = numbered(docs)
    want = {i for i, c in groups(sets_of(own.collect())).items() if i == c}
    kept = jaccard.one_of_each(own)
    assert kept.columns == own.columns
    assert {r.doc_id for r in kept.collect()} == want


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_token_counts(docs, empty, library):
    got = tokens.token_counts(docs, queries.vocabulary()).collect()
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = Counter((r.doc_id, len((r.text or "").encode()), n(r.text), n(r.text) > 2048) for r in docs.collect())
    assert Counter(map(tuple, got)) == want
    assert tokens.token_counts(empty, queries.vocabulary()).count() == 0


def test_chunks_start_anew(library):
    t = [x or "" for x in texts()]
    c = tokens.Chunks(queries.vocabulary(), {}, tokens.same, 10)
    for _ in range(2):
        assert [b"".join(v) for v in c.values(t)] == [np.asarray(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in t]


def test_ids_of_awkward_letters(library):
    """Letters whose lower case depends or grows, marks, fractions, decomposed letters, special strings, all letters of the plane."""
    odd = [*"İıΣσςßẞÅAaÉe\u0301\u030aﬁǅ½²٣क्षไ漢字한각가", "\u1112\u1161\u11ab", "<|endoftext|>", "</w>", "<unk>", *".,;:!?'-+_&\u2019\x1c\x00\u00a0\u200b\u3000\ufeff \n\t  "]
    r = random.Random(5)
    some = ["".join(r.choice(odd) for _ in range(r.randrange(1, 9))) for _ in range(20_000)] + ["DEĞERİ.", "ΣΑΣ. ΣΑΣ", "e\u0301."]
    letters = [chr(c) for c in range(128, 0x20000) if chr(c).isalpha()]
    some += [x for c in letters for x in (c, f"{c}.", f"a{c}b!")]
    c = tokens.Chunks(queries.vocabulary(), {}, tokens.same, 5000)
    for a in range(0, len(some), 500):
        part = some[a : a + 500]
        got = [b"".join(v) for v in c.values(part)]
        want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(part, add_special_tokens=False)]
        assert got == want, [t for t, x, y in zip(part, got, want, strict=True) if x != y]


def test_packing(docs, library):
    own = numbered(docs)
    text = {r.doc_id: r.text or "" for r in own.collect()}
    pieces = defaultdict(list)
    for r in tokens.packed(own, queries.vocabulary(), with_ids=True).collect():
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens, r.sequence_id))
    for i, t in text.items():
        ids = np.asarray([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(x[1] for x in sorted(pieces[i])) == ids and {x[2] for x in pieces[i]} == {len(ids) // 4}
    all_ = [x[3] for p in pieces.values() for x in p]
    assert len(set(all_)) == len(all_)


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) if k == 2 else 0
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and s % 10 == 0, 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(2)
    for _ in range(4000):
        t = "".join(r.choice("aB.@@-+ 0159(),\n") for _ in range(r.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_personal_data(docs, empty):
    for r, d in zip(sorted(pii.personal_data(numbered(docs)).collect()), sorted(numbered(docs).collect(), key=lambda r: r.doc_id), strict=True):
        spans = plain_spans(d.text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.told(spans).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [x for x in every if not x.startswith("term:")] == [x for x in pii.told(spans).split(",") if x]
    assert pii.personal_data(empty).count() == 0


def test_disclosing_terms_are_generalised(spark):
    rows = [(i, f"filler{i} text the call Zebulon at z@corp.example today number{i} the") for i in range(12)]
    rows += [(100 + i, f"the ordinary words of a text call today {i}") for i in range(300)]
    rows += [(500 + i, f"the name Zebulon{'' if i == 0 else 's'} alone") for i in range(2)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    for held in (1000, 0):
        assert [r.term for r in pii.disclosing_terms(d, held_terms=held).collect()] == ["zebulon"]
    clean = {r.doc_id: r.text for r in pii.sanitised_corpus(d).collect()}
    assert clean == {r.doc_id: r.text for r in pii.sanitised_corpus(d, most=0).collect()}
    assert clean[0] == "filler0 text the call [TERM] at [EMAIL] today number0 the" and clean[100] == rows[12][1] and clean[500] == "the name [TERM] alone"


def test_terms_disclose_from_anywhere_in_a_text(spark):
    """At the end of a text, in line-based records, and far from the value."""
    common = "the ordinary words of a call today "
    rows = [f"call a@b.com Zebulon {i}" if i % 2 else f"mail: a@b.com\nname:\nZebulon\n{i}" for i in range(12)]
    rows += [f"{i} Quillon\t{common * 20}c@d.com" for i in range(12)] + [f"{common}{i}" for i in range(400)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.term for r in pii.disclosing_terms(d).collect()} >= {"zebulon", "quillon"}
    assert {x for _, x in pii.contexts("call a@b.com Zebulon")} == {"call", "zebulon"}
    assert {x for _, x in pii.contexts("x" * 80 + "\nZebulon\na@b.com")} == {"x" * 80, "zebulon"}


def test_terms_of_any_letters(spark):
    """Counted as they are found: dotted capitals, fractions within a word, words in any case; brute force over the same rows."""
    rows = [f"call İstanbul ab½ ZEBULON at z@corp.example {i}" if i % 2 else f"call İSTANBUL AB½ Zebulon at z@corp.example {i}" for i in range(12)]
    rows += [f"the ordinary words of a call today {i} x@y.example" for i in range(300)] + [None, "", rows[0], rows[0]]
    d = spark.createDataFrame([(i, t, "e", 1, b"t") for i, t in enumerate(rows)], "doc_id long, text string, entity string, around int, term binary")
    texts = {t for t in rows if t is not None}
    have = {t: (pii.entities(t, pii.base_spans(t)), pii.words_beside(t, pii.base_spans(t))) for t in texts}
    n_e, n_t, n_et = Counter(), Counter(), Counter()
    for e, w in have.values():
        n_e.update(e)
        n_t.update(w)
        n_et.update((x, y) for x in e for y in w)
    want = {t for (e, t), n in n_et.items() if n >= 5 and math.log2(n * len(texts) / (n_e[e] * n_t[t])) >= 0.9 * math.log2(len(texts) / n_e[e])}
    assert want >= {"i̇stanbul", "ab½", "zebulon"}
    for held in (1000, 0):
        assert {r.term for r in pii.disclosing_terms(d, held_terms=held).collect()} == want
    for most in (1000, 0):
        got = {r.doc_id: r.spans for r in pii.personal_data(d, most=most).collect()}
        assert got[0].count("term") == 3 and got[len(rows) - 3] == "" and len(got) == len(rows)
    assert pii.disclosing_terms(d.filter("false")).count() == 0


def test_copies_do_not_hide_disclosing_terms(spark):
    """All counts are of different texts."""
    rows = [f"call Zebulon at z@corp.example {i}" for i in range(6)] + [f"the ordinary words of a call today {i}" for i in range(300)]
    rows += [rows[0]] * 200 + [rows[10]] * 50
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for held in (1000, 0):
        assert [r.term for r in pii.disclosing_terms(d, held_terms=held).collect()] == ["zebulon"]


def plain_length(nodes, context, symbol):
    """Bits by method C with exclusion over nested dictionaries: context -> next byte -> count."""
    bits, out = 0.0, set()
    for k in range(len(context) + 1):
        left = {s: c for s, c in nodes.get(context[k:], {}).items() if s not in out}
        if left:
            total = sum(left.values()) + len(left)
            if symbol in left:
                return bits - math.log2(left[symbol] / total)
            bits -= math.log2(len(left) / total)
            out.update(left)
    return bits + math.log2(256 - len(out))


def test_code_lengths_are_exact():
    """Those of nested dictionaries, over word borders; the probabilities of all bytes after a context sum to one, escapes and exclusion included."""
    taught = [["banana bandana", "cab banana"], ["zebra\u00e9 ab  cab", "x"]]
    counts = [np.unique(np.concatenate([language.grams(language.flat(t)) for t in own]), return_counts=True) for own in taught]
    plain = []
    for own in taught:
        nodes = defaultdict(Counter)
        for t in own:
            b = language.flat(t)
            for i in range(4, len(b)):
                for k in range(5):
                    nodes[b[i - k : i]][b[i]] += 1
        plain.append(nodes)
    for c, nodes in zip(counts, plain, strict=True):
        tree = language.Tree(*c)
        for context in (b"    ", b"bana", b"a ba", b"cab ", b"zzzz", b"zban"):
            codes = language.grams(b"".join(context + bytes([s]) for s in range(256)))[::5]
            got = tree.bits(codes)
            assert math.isclose(np.exp2(-got).sum(), 1, rel_tol=1e-9)
            assert np.allclose(got, [plain_length(nodes, context, s) for s in range(256)])
    texts = ["  banana zebra\ncab", "x", "Cab \u00c9" * 300, "q" * 5]
    for mb in (32, 0):
        got, n = language.Scorer(counts, mb).bits(texts)
        for t, row, size in zip(texts, got, n, strict=True):
            b = language.flat(t)
            assert size == len(b) - 4
            assert np.allclose(row, [sum(plain_length(x, b[i - 4 : i], b[i]) for i in range(4, len(b))) for x in plain])


def test_languages(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.99 * len(got) > 100
    assert sum(0.5 < r.score < 0.999 for r in got) > 0.9 * len(got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got)
    rows = language.languages(docs, keep=["text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        no_letter = r["__text"] is None or not any(c.isalpha() for c in r["__text"])
        assert (r.lang_pred == "und") == no_letter and 0 <= r.score <= 1 and (r.bits_per_byte is None) == no_letter
    assert language.languages(empty).count() == 0
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_unknown_languages_go(spark):
    """Long texts in an unlearned language or script go; very short clean ones, and all that the learned ones hold, stay."""
    d = spark.read.parquet(f"{D}/documents.parquet")
    few = [("Tämä kirjoitus on kieltä jota kukaan täällä ei ole oppinut, hyvää yötä kaikille ystäville ja myös muille. " * 4, 0), ("Это письмо на другом языке. " * 12, 0), ("zqxj vkqz jjxq wvzk " * 30, 0), ("von und", 1), ("The", 1), ("12 ½", 0)]
    more = spark.createDataFrame([(10_000 + i, t, None, f"s{k}", len(t)) for i, (t, k) in enumerate(few)], d.schema)
    kept = {r.doc_id: r.source for r in language.known_language(d.unionByName(more)).collect()}
    assert {i for i in kept if i < 10_000} == {r.doc_id for r in d.collect()}
    assert {i for i in kept if i >= 10_000} == {10_000 + i for i, (_, k) in enumerate(few) if k}
    assert language.known_language(d.filter("false")).count() == 0


def test_mixture(spark, docs, empty):
    for own in (docs, spark.read.parquet(f"{D}/documents.parquet")):
        rows = mixing.mixed_documents(own, block=16).collect()
        assert len(rows) == own.count()
        sizes = Counter()
        for r in own.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight, goal, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), set()
        while True:
            left = goal - sum(2 * sizes[s] for s in full)
            free = [s for s in names if s not in full]
            target = {s: 2 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
            over = {s for s in free if target[s] > 2 * sizes[s]}
            if not over:
                break
            full |= over
        key = lambda s: "n" if s is None else f"s{s}"
        taken = Counter()
        for r in rows:
            taken[r.key] += r.taken
            assert 0 <= r.taken <= 2 * r["size"]
        for s in names:
            own_rows = [r for r in rows if r.key == key(s)]
            assert all(math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == sizes[s] for r in own_rows)
            assert abs(taken[key(s)] - target[s]) <= 1
        again = mixing.mixed_documents(own, block=16).collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mixed_documents(empty).count() == 0
    assert set(mixing.mixed_corpus(docs).columns) == set(docs.columns)


def test_mixed_corpus_follows_the_schedule(spark):
    """Words to the target of each source, also from one long document, in the schedule's order."""
    rows = [(0, " ".join(f"a{i}" for i in range(3000)), "a", -1)] + [(i, " ".join(f"b{i}_{j}" for j in range(40)), "b", -1) for i in range(1, 101)] + [(200, " \tc0\n c1 ", "c", -1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = mixing.mixed_documents(d, block=16)
    want = {r.key[1:]: r.t for r in taken.groupBy("key").agg(F.sum("taken").alias("t")).collect()}
    got = mixing.mixed_corpus(d, block=16, width=50).collect()
    words = Counter()
    for r in got:
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == {k: n for k, n in want.items() if n}
    runs = [r.source for r in got]
    first = Counter()
    for r in got[: len(got) // 4]:
        first[r.source] += len(WORD.findall(r.text))
    assert abs(first["a"] / sum(first.values()) - want["a"] / sum(want.values())) < 0.05 and sum(x != y for x, y in zip(runs, runs[1:])) > 50


def test_schedule_is_even(spark):
    aims = spark.createDataFrame([("a", 5000), ("b", 2000), ("c", 1000), ("d", 3)], "key string, words long")
    slots = mixing.schedule(aims, 10).orderBy("slot").collect()
    assert Counter(r.key for r in slots) == {"a": 500, "b": 200, "c": 100, "d": 1}
    for k in "abc":
        assert [r["rank"] for r in slots if r.key == k] == list(range(sum(r.key == k for r in slots)))
    first = Counter(r.key for r in slots[:80])
    assert abs(first["a"] - 50) <= 3 and abs(first["b"] - 20) <= 3 and abs(first["c"] - 10) <= 3


def least_capacity(sizes, n):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, k, fill = (lo + hi) // 2, 1, 0
        for s in sizes:
            k, fill = (k, fill + s) if fill + s <= mid else (k + 1, s)
        lo, hi = (lo, mid) if k <= n else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("case", ["even", "one above the mean", "few", "one cell"])
def test_minimax_cuts_over_groups(spark, case):
    """The least capacity of the groups themselves, whatever cells they lie in, and shards near the mean."""
    r = random.Random(3)
    n_groups, n = {"even": (100_000, 40), "one above the mean": (20_000, 40), "few": (5, 7), "one cell": (3_000, 7)}[case]
    places = sorted(r.sample(range(1 << (60 if case != "one cell" else 20)), n_groups))
    sizes = [16 + int(r.paretovariate(1.3) * 300) for _ in places]
    if case == "one above the mean":
        sizes[777] = sum(sizes) // 3
    d = spark.createDataFrame(list(zip(places, sizes, strict=True)), "h long, bytes long").persist()
    cuts, cap = sharding.minimax_cuts(sharding.looker(d), n)
    assert len(cuts) == n - 1 and cuts == sorted(cuts) and cap == least_capacity(sizes, n)
    load = [0] * n
    for p, s in zip(places, sizes, strict=True):
        load[bisect.bisect_right(cuts, p)] += s
    assert max(load) <= cap
    if case in ("even", "one cell"):
        assert min(load) > sum(sizes) / n - 2 * max(sizes)
    d.unpersist()


def test_shards(docs, empty):
    docs = docs.unionByName(docs.filter("doc_id is null")).unionByName(docs.filter("doc_id is null"))
    rows = sharding.shards(docs, 7).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    by, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        by[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    groups = defaultdict(int)
    for r in docs.collect():
        text = (r.text or "").encode()
        groups[int(hashlib.md5(text).hexdigest()[:15], 16)] += len(text) + 16
    assert max(load.values()) <= least_capacity([groups[h] for h in sorted(groups)], 7)
    assert all(len(s) == 1 for s in by.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    assert sharding.shards(empty).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 64)).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(300 + i, x[0]) for i in range(60)] + [(400, None), (420, [0.0] * 64), (440, [float("nan")] * 64), (460, [None] * 64), (None, x[1]), (20, x[20])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))


def plain_search(vectors, score, k):
    rows = {(r.vec_id, tuple(r.embedding)) for r in vectors.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and all(map(math.isfinite, r.embedding)) and any(r.embedding)}
    return {i: sorted((score(np.array(v), np.array(w)), j) for j, w in rows if j != i)[:k] for i, v in rows if i % 20 == 0}


def test_hamming_search_is_exact(vectors):
    want = plain_search(vectors, lambda a, b: int(((a > 0) != (b > 0)).sum()), 10)
    for shard in (16_384, 50):
        got = defaultdict(list)
        for r in hamming.nearest_codes(vectors, per_shard=shard).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.distance, r.vec_id))
        assert got == want
    assert hamming.nearest_codes(vectors.filter("vec_id < 3")).count() == 2
    assert hamming.nearest_codes(vectors.filter("false")).count() == 0


def test_graph_search(spark, vectors):
    own = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for v, shard in ((vectors, 10_000), (own, 700)):
        want = plain_search(v, lambda a, b: -float(a @ b), 20)
        got = defaultdict(list)
        for r in graph.nearest_vectors(v, per_shard=shard).orderBy("query_id", "rank").collect():
            got[r.query_id].append((-r.score, r.vec_id))
        assert set(got) == set(want) and all(len(got[q]) == 20 for q in want)
        met = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
        assert met >= 0.95 * 20 * len(want)
        assert all(g == sorted(g) for g in got.values())
    assert graph.nearest_vectors(vectors.filter("false")).count() == 0


def test_graph_search_copies_no_queries_or_graphs(spark, vectors, monkeypatch):
    """Queries in several blocks, shards in one task or several: rows that leave the search grow with queries and tasks, not with shards."""
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    found = []
    monkeypatch.setattr(graph, "merged", lambda rows, *more: found.append(common.table(rows, 1).count()) or vectors_module.merged(rows, *more))
    want = plain_search(vectors, lambda a, b: -float(a @ b), 20)
    got = defaultdict(list)
    for r in graph.nearest_vectors(vectors, per_shard=20, block=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [j for _, j in w] for q, w in want.items()}
    assert len(found) == 3 and len(want) * 20 <= sum(found) <= 2 * len(want) * 20


def test_vectors_of_unequal_length_and_few_candidates(spark):
    """What a shorter vector lacks is zero; with fewer than k candidates all are found."""
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=64 - i % 3).tolist(), "x", 1, b"i") for i in range(15)] + [(60, [], "x", 1, b"i"), (40, [5.0], "x", 1, b"i")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string, block int, index binary")
    padded = {i: np.array([*np.float32(v), *[0.0] * (64 - len(v))], float) for i, v, *_ in rows if v}
    for found, score in ((graph.nearest_vectors(d, k=20), lambda a, b: -(a @ b)), (hamming.nearest_codes(d, k=20), lambda a, b: ((a > 0) != (b > 0)).sum())):
        want = {q: [j for _, j in sorted((score(padded[q], padded[j]), j) for j in padded if j != q)] for q in (0, 40)}
        got = defaultdict(list)
        for x in found.orderBy("query_id", "rank").collect():
            got[x.query_id].append(x.vec_id)
        assert got == want


def test_url_rules(spark):
    rows = [
        (1, "HTTP://Sub.Example.COM/en/7x?q", "sub.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"),
        (3, "x://example.net/de/88#t", "example.net", "/de/88", "example.net/de/8", "block"),
        (4, "x://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"),
        (5, None, "", "", None, "allow"),
        (6, "no scheme", "", "", None, "allow"),
        (7, "h://xcom/en/", "xcom", "/en/", None, "allow"),
        (8, "h://a.org?x/es/", "a.org", "", None, "allow"),
        (9, "", "", "", None, "allow"),
    ]
    d = spark.createDataFrame([(r[0], r[1], "h") for r in rows], "page_id long, url string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(d, queries.RULES).collect())
    assert got == sorted((r[0], *r[2:]) for r in rows)
    assert urls.judge(d.filter("false"), queries.RULES).count() == 0


def test_url_templates(spark):
    rows = [(f"http://h.x/shop/item-{i}/buy", 1 if i < 20 else None) for i in range(60)]
    rows += [(f"http://h.x/news/{i}", 0 if i < 20 else None) for i in range(60)]
    rows += [(f"http://h.x/{s}/{i}.html", 1 if i < 10 else None) for s in ("a", "b") for i in range(20)] + [(f"http://h.x/c/{i}.html", None if i > 9 else 0) for i in range(20)]
    d = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id long, url string, bad int")
    got = Counter((r.path.split("/")[1], r.verdict, r.template) for r in urls.judge(d, [], label=F.col("bad")).collect())
    assert got == {("shop", "block", "/shop/*/buy"): 60, ("news", "allow", None): 60, ("a", "block", "/*/{num}.html#5"): 20, ("b", "block", "/*/{num}.html#5"): 20, ("c", "allow", None): 20}


def judged(spark, rows):
    d = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id long, url string, bad int")
    return Counter((r.path.split("/")[-2], r.verdict, r.template) for r in urls.judge(d, [], label=F.col("bad")).collect())


def test_url_templates_of_deep_paths(spark):
    rows = [("http://h.x/a/b/c/d/", 0)] * 6 + [(f"http://h.x/a/b/c/d/spam/item-{i}x/buy/", 1 if i < 20 else None) for i in range(60)]
    rows += [(f"http://h.x/a/b/c/d/good/e/f/g/h/{i}/", 0 if i < 20 else None) for i in range(30)]
    got = judged(spark, [(f"{u}end", y) for u, y in rows])
    assert got == {("d", "allow", None): 6, ("buy", "block", "/a/b/c/d/spam/*/buy/end"): 60, **{(str(i), "allow", None): 1 for i in range(30)}}


def test_url_templates_do_not_depend_on_visits(spark):
    rows = [(f"http://h.x/s/slug-{i}x", 1 if i < 20 else None) for i in range(60)]
    want = {("s", "block", "/s/*"): 60}
    assert judged(spark, rows) == want
    assert judged(spark, rows * 3) == {k: 3 * n for k, n in want.items()}
    assert judged(spark, rows + rows[:1] * 500) == {k: n + 500 for k, n in want.items()}
    assert judged(spark, rows + [("http://h.x/s/slug-0x", 1)] + [(f"http://h.x/s/slug-0x/p{i}y{i}", 1) for i in range(20)])["s", "block", "/s/*"] == 61


def test_stages_hand_small_batches_to_python(spark):
    """What the JVM holds outside its heap for a batch is bounded where the stages' plans run; the session's own setting stays, and a smaller one holds."""

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    import corpus_pipeline

    counted = spark.range(0, 1300, 1, 1).mapInArrow(sizes, "n long")
    assert sorted(r.n for r in counted.collect()) == [1300]
    assert sorted(r.n for r in common.small_batches(counted).collect()) == sorted(r.n for r in common.table(counted).collect()) == [300, 500, 500]
    before = spark.conf.get(common.BATCH)
    spark.conf.set(common.BATCH, "70")
    assert max(r.n for r in common.small_batches(counted).collect()) == 70
    spark.conf.set(common.BATCH, before)
    d = spark.read.parquet(f"{D}/documents.parquet")
    outs = [language.known_language(d), pii.sanitised_corpus(d), corpus_pipeline.packing_stage(spark, d, D)]
    assert [int(o.sparkSession.conf.get(common.BATCH)) for o in outs] == [500] * 3 and spark.conf.get(common.BATCH) == before


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{D}/documents.parquet")
    first = language.known_language(d)
    assert first.columns == d.columns and first.count() == d.count()
    assert corpus_pipeline.run(spark, D).filter("length > 0").count() > 0


CLASHING = "__id __text __null __h __kept __key __slot __first __piece __pieces __words __around __terms __hot __salt own_text n_email spans lang_pred score held_out bits_per_byte slot rank chunk taken target bucket at n length start ids cut term lens blob vec_id block".split()


@pytest.mark.parametrize("stage", [language.known_language, jaccard.one_of_each, pii.sanitised_corpus, mixing.mixed_corpus], ids=lambda f: f.__name__)
def test_stages_keep_columns_of_any_name(docs, empty, stage):
    """Columns beside those a stage uses come through as they are, whatever their names; null ids, repeated rows and empty tables do no harm."""
    own = docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})
    got = stage(own)
    assert got.columns == own.columns and stage(own.filter("false")).count() == 0 == stage(empty).count()
    rows, n = list(map(tuple, got.collect())), len(docs.columns)
    assert Counter(r[:n] for r in rows) == Counter(map(tuple, stage(docs).collect()))
    assert {r[n:] for r in rows} == {tuple(range(len(CLASHING)))}


@pytest.mark.parametrize("query", [lambda d: tokens.token_counts(d, queries.vocabulary()), lambda d: tokens.packed(d, queries.vocabulary()).drop("sequence_id"), pii.personal_data, sharding.shards, mixing.mixed_documents, jaccard.similar_components, language.languages], ids=["tokens", "packed", "personal", "shards", "mixed", "similar", "languages"])
def test_results_do_not_depend_on_other_columns(docs, query):
    own = docs.withColumns({c: F.lit("7") for c in CLASHING if c not in docs.columns})
    rows = Counter(map(tuple, query(docs).collect()))
    assert Counter(map(tuple, query(own).collect())) == rows and query(docs.filter("false")).count() == 0
    assert rows


def test_url_awkward_rows(spark):
    """Copies, null ids, rules of equal length, very long urls and many segments."""
    rules = [("block", "x.com/a"), ("allow", "com/ab/c"), ("allow", "x.com/b"), ("block", "x.com/b/")]
    rows = [(None, "h://x.com/a", "block"), (None, "h://x.com/a", "block"), (1, "h://x.com/ab/c", "allow"), (2, "h://x.com/b/", "block"), (3, "h://x.com/" + "s/" * 300, "allow"), (4, "h://y.com/" + "z" * 100_000, "allow"), (4, "h://y.com/" + "z" * 100_000, "allow"), (5, "h://", "allow")]
    d = spark.createDataFrame([(i, u, 7, "x") for i, u, _ in rows], "page_id long, url string, labelled int, template string")
    got = urls.judge(d, rules).collect()
    assert Counter((r.page_id, r.path, r.verdict) for r in got) == Counter((i, u.split("://")[1][u.split("://")[1].find("/") :] if "/" in u.split("://")[1] else "", v) for i, u, v in rows)
