"""URL verdicts: listed rules first, then per-host path templates rejected by their smoothed labelled purity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hueweave.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that vary by their form alone; braces do not stand unescaped in a URL.
FORMS = (
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "{uuid}"),
    (r"^(?=[a-f]*[0-9])[0-9a-f]{16,}", "{hex}"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "{date}"),
    (r"^[0-9]+", "{num}"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Null, or without ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action. A rule is a host and a path; it fits the host, its subdomains and paths that start so.

    Rules are a parameter, each an expression of the scan; ties go to the rule listed first."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def form(segment: Column) -> Column:
    """A segment with what varies by form alone (numbers, dates, hashes) named by its kind; endings such as .html stay."""
    return reduce(lambda s, f: F.regexp_replace(s, *f), FORMS, segment)


def templates(paths: DataFrame, min_children: int = 24, min_spread: float = 0.5, similar_z: float = 1.64) -> DataFrame:
    """paths(host, segs, n, labelled, bad) with template, and with labelled and bad of all paths that share it; n counts different paths.

    Level by level, until no path goes on, a node's children are generalised to * where there are min_children of them and
    min_spread of them have no more than 1 / min_spread different paths below, which is how ids and slugs differ from sections;
    visits do not count, and a child of many paths is but one child. Below a node of fewer than min_children paths none can
    be generalised, so these paths end there as they are; only paths that many share go on level by level. Sibling
    templates that differ in one literal then merge: branches whose share of bad labels is within similar_z standard
    errors of that of all siblings together, and of the others those of one fifth of the scale (named with #); branches without labels stay
    apart. Nothing is kept per host in one task: each level is two aggregations and a join on (host, node), written before
    the next, so plans stay small however deep paths are."""
    p, done, level = table(paths.withColumn("node", F.lit(""))), [], 0
    while True:
        done.append(p.filter(F.size("segs") <= level))
        p = p.filter(F.size("segs") > level).withColumn("child", F.col("segs")[level])
        kids = p.groupBy("host", "node", "child").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        kids = kids.groupBy("host", "node").agg(F.count("*").alias("k"), F.count_if(F.col("n") * min_spread <= 1).alias("thin"), F.sum("rows").alias("rows"))
        large = kids.filter(F.col("rows") >= min_children).select("host", "node", ((F.col("k") >= min_children) & (F.col("thin") >= min_spread * F.col("k"))).alias("wide"))
        rest = F.array_join(F.slice("segs", level + 1, F.size("segs")), "/")
        step = F.when(F.col("wide").isNull(), rest).when(F.col("wide"), "*").otherwise(F.col("child"))
        p = table(p.join(large, ["host", "node"], "left").select(*paths.columns, F.concat("node", F.lit("/"), step).alias("node"), F.col("wide").isNull().alias("over")))
        done.append(p.filter("over").drop("over"))
        p = p.filter("not over").drop("over")
        level += 1
        if p.isEmpty():
            break
    p = reduce(DataFrame.unionByName, done)
    own = p.groupBy("host", F.col("node").alias("template")).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    # the last literal is what siblings differ in
    stem = F.regexp_replace("template", r"/[^/*{]+((?:/(?:\*\*?|\{[^/]*))*)$", r"/*$1")
    own = own.withColumn("stem", stem)
    all_ = own.groupBy("host", "stem").agg(F.sum("labelled").alias("s_labelled"), F.sum("bad").alias("s_bad"))
    rate, own_rate = F.try_divide("s_bad", "s_labelled"), F.try_divide("bad", "labelled")
    error = F.sqrt(F.try_divide(rate * (1 - rate), F.col("labelled")))
    alike = F.abs(own_rate - rate) <= similar_z * error + 1e-9
    band = F.concat(F.col("stem"), F.lit("#"), F.round(own_rate * 5).cast("int").cast("string"))
    merged = own.join(all_, ["host", "stem"]).withColumn("merged", F.when(alike, F.col("stem")).otherwise(F.coalesce(band, "template")))
    groups = merged.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("branches"))
    named = merged.select("host", F.col("template").alias("node"), "merged").join(groups, ["host", "merged"])
    named = named.withColumn("template", F.when(F.col("branches") == 1, F.col("node")).otherwise(F.col("merged")))
    return p.drop("labelled", "bad").join(named, ["host", "node"]).select("host", "segs", "template", "labelled", "bad")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label: Column | None = None, min_labelled: int = 5, prior: float = 0.1, weight: float = 4.0, reject: float = 0.8, **tree) -> DataFrame:
    """page_id, host, path, rule, verdict and template, a row for each row of pages.

    label: 1 for a bad page, 0 for a good one, null where unknown; by default a rule's verdict is the label of the page it
    fits. A template is rejected where at least min_labelled of its pages have labels and
    (bad + weight * prior) / (labelled + weight) is at least `reject`; its pages without a rule are blocked, all others allowed.
    Null urls have empty host and path and are allowed; equal rows get equal results; other columns are ignored.
    Pages meet templates by (host, form of the path); rows are first summed by it, so a hot host is a few rows."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), (F.lit(None).cast("int") if label is None else label.cast("int")).alias("label"))
    rule, action = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action})
    if label is None:
        rows = rows.withColumn("label", F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0))
    raw = F.filter(F.split("path", "/"), lambda s: s != "")
    segs = F.transform(raw, form)
    rows = rows.withColumn("segs", segs)
    each = rows.groupBy("host", "segs", raw.alias("raw")).agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    paths = each.groupBy("host", "segs").agg(F.count("*").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    found = templates(paths, **tree)
    purity = (F.col("bad") + weight * prior) / (F.col("labelled") + weight)
    rejected = found.filter((F.col("labelled") >= min_labelled) & (purity >= reject)).select("host", "segs", "template")
    out = rows.join(rejected, ["host", "segs"], "left")
    verdict = F.coalesce("action", F.when(F.col("template").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")
