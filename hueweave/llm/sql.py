"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x20\x09-\x0D]+')"
#: Segments of a path that the SQL of op1 goes down; deeper ones are those of no given URL.
DEPTH = 8


def urls(rules: list[tuple[str, str]]) -> str:
    """Rules, then the path templates of each host, level by level."""
    fits = lambda text: (lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')")(*text.split("/", 1))
    order = sorted(rules, key=lambda r: -len(r[1]))
    pick = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[i]}'" for r in order) + " END"
    uuid = "^" + "-".join(f"[0-9a-fA-F]{{{n}}}" for n in (8, 4, 4, 4, 12))
    form = f"regexp_replace(s, '{uuid}', '{{uuid}}')"
    form = f"(CASE WHEN regexp_matches({form}, '^[a-f]*[0-9]') THEN regexp_replace({form}, '^[0-9a-f]{{16,}}', '{{hex}}') ELSE {form} END)"
    form = f"regexp_replace(regexp_replace({form}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '{{date}}'), '^[0-9]+', '{{num}}')"
    out = [
        "u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"r AS MATERIALIZED (SELECT *, {pick(1)} AS rule, {pick(0)} AS action, list_filter(string_split(path, '/'), lambda s: s <> '') AS raw FROM hp)",
        f"s AS MATERIALIZED (SELECT *, list_transform(raw, lambda s: {form}) AS segs, CASE action WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS label FROM r)",
        "p0 AS MATERIALIZED (SELECT host, segs, count(DISTINCT raw) AS n, count(label) AS labelled, coalesce(sum(label), 0) AS bad, '' AS node FROM s GROUP BY host, segs)",
    ]
    for i in range(DEPTH):
        out += [
            f"k{i} AS (SELECT host, node, segs[{i + 1}] AS child, sum(n) AS n FROM p{i} WHERE len(segs) > {i} GROUP BY ALL)",
            f"w{i} AS (SELECT host, node FROM k{i} GROUP BY host, node HAVING count(*) >= 24 AND count(*) FILTER (WHERE n <= 2) >= 0.5 * count(*))",
            f"p{i + 1} AS MATERIALIZED (SELECT p.host, p.segs, p.n, p.labelled, p.bad, CASE WHEN len(p.segs) <= {i} THEN p.node ELSE p.node || '/' || CASE WHEN w.host IS NULL THEN p.segs[{i + 1}] ELSE '*' END END AS node FROM p{i} p LEFT JOIN w{i} w ON w.host = p.host AND w.node = p.node)",
        ]
    out += [
        f"own AS (SELECT host, node, regexp_replace(node, '/[^/*{{]+((?:/(?:\\*\\*?|\\{{[^/]*))*)$', '/*\\1') AS stem, sum(labelled) AS labelled, sum(bad) AS bad FROM p{DEPTH} GROUP BY host, node)",
        "al AS (SELECT host, stem, sum(bad) / nullif(sum(labelled), 0) AS rate FROM own GROUP BY host, stem)",
        "mg AS (SELECT own.*, CASE WHEN abs(bad / nullif(labelled, 0) - rate) <= 1.64 * sqrt(rate * (1 - rate) / nullif(labelled, 0)) + 1e-9 THEN stem ELSE coalesce(stem || '#' || CAST(CAST(round(bad / nullif(labelled, 0) * 5) AS INTEGER) AS VARCHAR), node) END AS merged FROM own JOIN al USING (host, stem))",
        "gr AS (SELECT host, merged, sum(labelled) AS labelled, sum(bad) AS bad, count(*) AS branches FROM mg GROUP BY host, merged)",
        f"rj AS (SELECT p.host, p.segs, CASE WHEN branches = 1 THEN mg.node ELSE mg.merged END AS template FROM p{DEPTH} p JOIN mg ON mg.host = p.host AND mg.node = p.node JOIN gr ON gr.host = mg.host AND gr.merged = mg.merged WHERE gr.labelled >= 5 AND (gr.bad + 0.4) / (gr.labelled + 4.0) >= 0.8)",
    ]
    return "WITH " + ",\n".join(out) + "\nSELECT page_id, s.host AS host, path, rule, CASE WHEN action IS NOT NULL THEN action WHEN rj.template IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, rj.template AS template FROM s LEFT JOIN rj ON rj.host = s.host AND rj.segs = s.segs"


MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
sz AS (SELECT source, coalesce('s' || source, 'n') AS key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM sz),
l AS (SELECT *, cap / w AS level FROM w),
b AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS goal, sum(w) OVER () AS all_w, coalesce(sum(cap) OVER f, 0) AS cap_b, coalesce(sum(w) OVER f, 0) AS w_b FROM l WINDOW f AS (ORDER BY level, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, (goal - cap_b) / (all_w - w_b) AS rest, level <= (goal - cap_b) / (all_w - w_b) AS full_ FROM b),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE w * (SELECT rest FROM e WHERE NOT full_ ORDER BY level, key LIMIT 1) END AS target FROM e),
a AS (SELECT *, CAST(least(floor(target + 1e-6), 2 * source_size) AS BIGINT) AS words FROM t),
p AS (SELECT d.doc_id, d.size, a.source_size, a.target, a.words, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - d.size AS pos FROM d JOIN a ON a.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(size, words % source_size - pos)) END AS BIGINT) AS taken FROM p"""

#: The capacity is searched by bisection, a row for every step of a greedy filling; then ends of shards go from the last to the first, and from the first to the last.
SHARDS = r"""
WITH RECURSIVE tb(i, bit, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i) UNION ALL SELECT i, bit + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tb WHERE bit < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM tb WHERE bit = 8),
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 16 AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h,
    coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT greatest(64, count(*) // 800000) FROM documents), 0) AS salt FROM documents),
cr AS MATERIALIZED (SELECT text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT text FROM d), tab),
g AS MATERIALIZED (SELECT h, sum(size) AS bytes FROM d GROUP BY h),
gp AS MATERIALIZED (SELECT h, bytes, CAST(sum(bytes) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) - bytes AS BIGINT) AS start FROM g),
ln AS MATERIALIZED (SELECT list_append(list(start ORDER BY start), CAST(sum(bytes) AS BIGINT)) AS p, CAST(sum(bytes) AS BIGINT) AS total, CAST(max(bytes) AS BIGINT) AS most FROM gp),
bis(lo, hi, k, pos) AS (
  SELECT greatest(most, -(-total // 40)), greatest(most, -(-total // 40)) + most, 0, CAST(0 AS BIGINT) FROM ln
  UNION ALL
  SELECT CASE WHEN k = 39 AND nxt < total THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN nxt = total THEN (lo + hi) // 2 ELSE hi END, CASE WHEN nxt = total OR k = 39 THEN 0 ELSE k + 1 END, CASE WHEN nxt = total OR k = 39 THEN 0 ELSE nxt END
  FROM (SELECT bis.*, ln.total, list_max(list_filter(ln.p, lambda x: x <= pos + (lo + hi) // 2)) AS nxt FROM bis, ln WHERE lo < hi)),
cap AS MATERIALIZED (SELECT min(hi) AS c FROM bis),
back(k, pos) AS (SELECT 40, total FROM ln UNION ALL SELECT k - 1, list_min(list_filter(ln.p, lambda x: x >= pos - cap.c)) FROM back, ln, cap WHERE k > 1),
fore(k, pos) AS (
  SELECT 0, CAST(0 AS BIGINT)
  UNION ALL
  SELECT k + 1, least(greatest(CASE WHEN 2 * (total - pos) <= (low + high - 2 * pos) * (40 - k) THEN low ELSE high END, least_at, pos), far)
  FROM (SELECT fore.k, fore.pos, ln.total, back.pos AS least_at, list_max(list_filter(ln.p, lambda x: x <= fore.pos + cap.c)) AS far,
      list_max(list_filter(ln.p, lambda x: (x - fore.pos) * (40 - fore.k) <= ln.total - fore.pos)) AS low, list_min(list_filter(ln.p, lambda x: (x - fore.pos) * (40 - fore.k) >= ln.total - fore.pos)) AS high
    FROM fore JOIN back ON back.k = fore.k + 1, ln, cap WHERE fore.k < 39)),
sh AS MATERIALIZED (SELECT h, CAST((SELECT count(*) FROM fore WHERE fore.k > 0 AND fore.pos <= gp.start) AS INTEGER) AS shard FROM gp)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, cr.crc AS text_crc32, 'bytes' AS law, sh.shard AS shard,
  row_number() OVER (PARTITION BY sh.shard ORDER BY d.salt, d.doc_id NULLS FIRST, d.h) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN cr ON cr.text = d.text JOIN sh ON sh.h = d.h"""

LINKED = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
r(root, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.root, l.b FROM r JOIN l ON r.node = l.a WHERE r.root < l.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id"""

HAMMING = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, len(list_filter(list_zip(q.code, c.code), lambda z: z[1] <> z[2])) AS distance
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS nth FROM d)
SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, CAST(distance AS BIGINT) AS distance FROM r WHERE nth <= 10"""


def oracle(rules: list[tuple[str, str]]) -> dict[str, str]:
    return {"op1_url_templates": urls(rules), "op2_hamming_topk": HAMMING, "op3_source_mix": MIX, "op4_minimax_shards": SHARDS, "op8_ngram_jaccard": LINKED}
