"""URL filter: host and path rules, then a ratio of two character language models. DataFrame functions only.

URLs that a rule accepts and those that one rejects train a variable-order Markov model each: counts of the five characters that
end at every place of a URL give the counts of all shorter contexts, smoothed from order to order (Witten and Bell: the number of
distinct successors of a context is the weight of the next shorter one). A URL's score is the mean over its characters of the
log ratio accepted / rejected, at the longest context that either model has seen, plus the escape weights of the longer ones.
The cut between the verdicts lies between the two training classes' mean scores, divided by their spreads.

The model is kept by the grams and contexts themselves, every one that was counted, and joined on them without a broadcast hint. The distinct
grams of the URLs to be scored get their values from the shortest order up, so no join has a key that more rows share than there are characters;
only the last one, which brings the values to the URLs, has common keys, and AQE can split those.

Nulls and cases: a null URL, or one without `://`, has an empty host and path and fits no rule; a null or empty URL, and any URL where the
rules label no URL of one class, is allowed by default, as is a score equal to the cut. URLs of any length are scored whole, each character once. The cut is
fitted on the URLs that train the models; none are held out for it. Repeated rows are judged alike. Empty tables give no rows. Other columns
are passed on by `url_filter` unless their names are those of its results, which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import saved, work_dir

#: Rules as (verdict, host and path); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ORDER = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased) and path (then up to `?`, `#` or the end)."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_replace(url, r"^(?s).*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null) and ruling (its verdict)."""
    host, path = url_parts(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(slash + p)
        rule, ruling = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return pages.withColumns({"rule": rule, "ruling": ruling})


def _grams(url: Column) -> Column:
    """For every character of the URL and an end mark, the ORDER characters that end there (start marks before the first)."""
    marked = F.concat(F.lit("\x02" * (ORDER - 1)), url, F.lit("\x03"))
    return F.when(F.length(url) > 0, F.regexp_extract_all(marked, F.lit("(?s)(?=(.{%d}))" % ORDER), F.lit(1)))


def train(labelled: DataFrame, path: str) -> DataFrame:
    """(kind, k, g, v): for each order k the log ratios of grams g (kind lr) and of the escape weights of contexts g (kind esc)."""
    grams = labelled.select("ruling", F.explode(_grams(F.col("url"))).alias("g")).groupBy("g").agg(*(F.count_if(F.col("ruling") == v).alias(v[0]) for v in ("allow", "block")))
    grams = saved(grams, f"{path}/grams")  # the only table here that is made from all URLs
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        t = grams.groupBy(F.expr(f"right(g, {k})").alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("c", F.expr(f"left(g, {k - 1})"))
        contexts = t.groupBy("c").agg(*(F.sum(x).alias(f"{x}n") for x in "ab"), *(F.count_if(F.col(x) > 0).alias(f"{x}t") for x in "ab"))
        if lower is None:
            t = t.withColumns({"qa": F.lit(1 / 256), "qb": F.lit(1 / 256)})
        else:
            t = t.withColumn("s", F.expr(f"right(g, {k - 1})")).join(lower.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pb").alias("qb")), "s")
        t = t.join(contexts, "c")
        p = {f"p{x}": F.when(F.col(f"{x}n") > 0, (F.col(x) + F.col(f"{x}t") * F.col(f"q{x}")) / (F.col(f"{x}n") + F.col(f"{x}t"))).otherwise(F.col(f"q{x}")) for x in "ab"}
        lower = saved(t.select("g", "a", "b", *(v.alias(n) for n, v in p.items())), f"{path}/order{k}")
        parts.append(lower.select(F.lit("lr").alias("kind"), F.lit(k).alias("k"), "g", F.log(F.col("pa") / F.col("pb")).alias("v")))
        escape = {x: F.when(F.col(f"{x}n") > 0, F.col(f"{x}t") / (F.col(f"{x}n") + F.col(f"{x}t"))).otherwise(1.0) for x in "ab"}
        parts.append(contexts.select(F.lit("esc").alias("kind"), F.lit(k).alias("k"), F.col("c").alias("g"), F.log(escape["a"] / escape["b"]).alias("v")))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.union(x)
    return saved(rows, f"{path}/model")


def values(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(g, v) for the distinct grams g: the log ratio of the longest counted end of g, plus the escape weights of the longer contexts."""
    asked = {ORDER: grams.select("g").distinct()}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select(F.expr(f"right(g, {k})").alias("g")).distinct()
    lower = None
    for k in range(1, ORDER + 1):
        of = lambda kind, key, k=k: model.where((F.col("kind") == kind) & (F.col("k") == k)).select(F.col("g").alias(key), F.col("v").alias(kind))
        t = asked[k].withColumns({"c": F.expr(f"left(g, {k - 1})"), "s": F.expr(f"right(g, {k - 1})")}).join(of("lr", "g"), "g", "left").join(of("esc", "c"), "c", "left")
        t = t.withColumn("low", F.lit(0.0)) if lower is None else t.join(lower.select(F.col("g").alias("s"), F.col("v").alias("low")), "s")
        lower = t.select("g", F.coalesce("lr", F.coalesce("esc", F.lit(0.0)) + F.col("low")).alias("v"))
    return lower


def scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(url, score) for each distinct URL that is not null or empty: the mean log ratio accepted / rejected of its characters."""
    at = urls.select("url").where("url <> ''").distinct().select("url", F.explode(_grams(F.col("url"))).alias("g"))
    return at.join(values(at, model), "g").groupBy("url").agg(F.avg("v").alias("score"))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block: the rule's, else the model's), score and cut."""
    taken = {"host", "path", "rule", "ruling", "verdict", "score", "cut", "_scored"}
    pages = ruled(pages.select(*(F.col(f"`{c}`") for c in pages.columns if c.lower() not in taken)), rules)
    path = work_dir(pages.sparkSession, "url")
    labelled = pages.where("ruling is not null and url is not null").select("url", "ruling")
    model = train(labelled, path)
    scored = saved(scores(pages, model), f"{path}/scores")
    fit = {r["ruling"]: r for r in labelled.join(scored, "url").groupBy("ruling").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}  # two rows
    cut = None
    if len(fit) == 2:
        a, b = fit["allow"], fit["block"]
        sa, sb = max(a["s"], 1e-6), max(b["s"], 1e-6)
        cut = (a["m"] * sb + b["m"] * sa) / (sa + sb)
    out = pages.join(scored.select(F.col("url").alias("_scored"), "score"), F.col("url") == F.col("_scored"), "left").drop("_scored").withColumn("cut", F.lit(cut).cast("double"))
    judged = F.when(F.col("score") < F.col("cut"), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("ruling", judged)).drop("ruling")
