"""URL filters (operator 3): block and allow rules, and for all other urls
gradient-boosted trees on lexical features.

A rule names a host and a path beginning; it fits the host and its subdomains
if the url's path begins so, and of several the longest rule wins.  Urls that a
rule decides are the labelled ones.  The trees learn from them: lengths, depth,
digit ratio, character entropy, parameter counts, and label statistics of the
host's last label and last two labels.  A labelled url's own label is taken out
of its statistics (leave one out), so they do not give it away.

Training takes at most ``TRAIN_URLS`` labelled urls, drawn by hash of row and url;
statistics cover all of them.  Everything runs as column expressions and MLlib.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule, and is judged on what text it has; if all labelled urls agree, the
method gives their verdict, and without any it allows; urls of any length are
read whole; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlift.llm.common import materialise, table
from donorlift.llm.queries import query

#: (verdict, host, path beginning)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled urls that the trees are trained on, at most.
TRAIN_URLS = 200_000
TREES, DEPTH, STEP = 20, 4, 0.3
#: Weight of the overall block rate in a suffix's rate, in urls.
SMOOTH = 20.0
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ["n", "host_n", "path_n", "depth", "labels", "digits", "marks", "params", "param_n", "escapes", "entropy", "tls", "port", "last_rate", "last_n", "pair_rate", "pair_n"]


def with_parts(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.select("page_id", "url", F.translate(F.regexp_extract(url, PARTS, 1), upper, lower).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))


def fitting_rule(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in longest])
    fits = F.filter(rows, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(F.transform(fits, lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))), F.lit(0))


def lexical(df: DataFrame) -> DataFrame:
    """Lexical features of url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    count = lambda text, pattern: n_of(text, pattern).cast("double")
    query_part = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    # entropy over printable ASCII; linear in the url
    codes = F.transform(F.sequence(F.lit(33), F.lit(126)), lambda c: F.char(c))
    share = F.transform(codes, lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / F.greatest(n, F.lit(1)))
    entropy = F.aggregate(share, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return df.withColumns(
        {
            "n": n.cast("double"),
            "host_n": F.length("host").cast("double"),
            "path_n": F.length("path").cast("double"),
            "depth": count(F.col("path"), r"/"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digits": n_of(url, r"[0-9]") / F.greatest(n, F.lit(1)),
            "marks": count(url, r"[-_~]"),
            "params": F.when(query_part != "", F.size(F.split(query_part, "[&;]"))).otherwise(0).cast("double"),
            "param_n": F.length(query_part).cast("double"),
            "escapes": count(url, "%[0-9A-Fa-f]{2}"),
            "entropy": entropy,
            "tls": F.startswith(F.lower(url), F.lit("https")).cast("double"),
            "port": F.col("host").rlike(":[0-9]+$").cast("double"),
            "last": F.substring_index("host", ".", -1),
            "pair": F.substring_index("host", ".", -2),
        }
    )


def n_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def with_rates(df: DataFrame, stats: dict[str, DataFrame], rate: float) -> DataFrame:
    """Smoothed block rates of the host's suffixes; a labelled row (``label``
    not null) is left out of its own."""
    own, one = F.coalesce(F.col("label"), F.lit(0.0)), F.when(F.col("label").isNull(), 0.0).otherwise(1.0)
    for name, rows in stats.items():
        seen = rows.select(F.col(name), F.col("blocked").alias("__b"), F.col("urls").alias("__n"))
        df = df.join(seen, name, "left")
        n = F.coalesce(F.col("__n"), F.lit(0)) - one
        df = df.withColumn(f"{name}_rate", (F.coalesce(F.col("__b"), F.lit(0.0)) - own + SMOOTH * rate) / (n + SMOOTH)).withColumn(f"{name}_n", F.log1p(F.greatest(n, F.lit(0.0)))).drop("__b", "__n")
    return df


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, train_urls: int = TRAIN_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's block score of every
    url (null where a rule decides)."""
    rows = with_parts(pages.select("page_id", "url"))
    rows = rows.withColumn("r", fitting_rule(rules, F.col("host"), F.col("path")))
    rows = rows.withColumn("label", F.when(F.col("r").isNotNull(), (F.col("r.verdict") == "block").cast("double")))
    rows = materialise(lexical(rows).select("page_id", "host", "path", F.col("r.rule").alias("rule"), "label", F.xxhash64("page_id", "url").alias("h"), "last", "pair", *FEATURES[:-4]), "urls")
    known = rows.where(F.col("label").isNotNull())
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    named = [F.col(c) for c in ("page_id", "host", "path", "rule")]
    by_rule = known.select(*named, F.when(F.col("label") == 1, "block").otherwise("allow").alias("verdict"), F.lit(None).cast("double").alias("score"))
    open_urls = rows.where(F.col("label").isNull())
    if not total.n or total.blocked in (0, total.n):
        share = float(total.blocked / total.n) if total.n else 0.0
        return by_rule.unionAll(open_urls.select(*named, F.lit("block" if share else "allow").alias("verdict"), F.lit(share).alias("score")))

    rate = total.blocked / total.n
    stats = {name: materialise(known.groupBy(name).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("urls")), "suffixes", compact=True) for name in ("last", "pair")}
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    drawn = known.where(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * min(1.0, train_urls / total.n)))
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, maxMemoryInMB=64)
    model = trees.fit(vector.transform(with_rates(drawn, stats, rate)).select("label", "features"))
    scored = model.transform(vector.transform(with_rates(open_urls, stats, rate)))
    score = F.element_at(vector_to_array("probability"), 2)
    judged = scored.select(*named, score.alias("score"))
    return by_rule.unionAll(judged.select("page_id", "host", "path", "rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("verdict"), "score"))


@query("op3_urls")
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))
