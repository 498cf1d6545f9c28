"""URL filters: fixed host and path rules, and association rules mined by Spark's FP-growth for the rest. Native only.

Pages that a fixed rule fits are the labelled examples: each one is a transaction of its URL's tokens (host suffixes,
host labels, directory prefixes of the path, query parameter names) and the rule's verdict as one more item. FP-growth
mines the frequent item sets; rules whose consequent is a verdict and whose confidence and support pass the bounds
are kept. A URL that no fixed rule fits takes the verdict of the best mined rule whose tokens it all has: tokens are
matched with an inverted index (rule items joined with URL tokens, counted per URL and rule), never one URL against
every rule.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtables.llm.stored import lookup, saved

# Fixed values of the contract: (host, path, verdict); a rule fits its host, all subdomains and all longer paths.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Mining bounds: an item set must be in this share of the labelled pages, a rule right in this share of its pages.
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
#: The verdict of a URL that neither a fixed nor a mined rule fits.
OTHERWISE = "allow"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or
    the end. A null URL (column `url`), or one without `://`, has an empty host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    on_host = (host == F.lit(rule_host)) | host.endswith(F.lit("." + rule_host))
    return on_host & path.startswith(F.lit(rule_path))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits (as `host` + `path`, like `net/`) and its verdict; nulls where none fits.

    Rules are few and fixed, so they are one expression, tried from the longest: no join, no shuffle.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = _fits(host, path, rule_host, rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct items of a URL: `host:` each suffix of the host at a dot, `label:` each label of the host, `dir:`
    each directory prefix of the path, `query:` each parameter name."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    directories = F.regexp_extract_all(path, F.lit(r"(/[^/]*)(?=/)"), 0)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(directories)),
                           lambda i: F.concat(F.array_join(F.slice(directories, 1, i), ""), F.lit("/")))
    query = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), 1)
    items = F.concat(
        F.transform(F.filter(suffixes, lambda s: s != ""), lambda s: F.concat(F.lit("host:"), s)),
        F.transform(F.filter(labels, lambda s: s != ""), lambda s: F.concat(F.lit("label:"), s)),
        F.transform(F.when(F.size(directories) > 0, prefixes).otherwise(F.array().cast("array<string>")),
                    lambda s: F.concat(F.lit("dir:"), s)),
        F.transform(query, lambda s: F.concat(F.lit("query:"), s)),
    )
    return F.array_distinct(items)


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule, verdict, items, n_items, confidence, support, anchor from `labelled` (items: tokens, verdict).

    FP-growth sees every distinct labelled URL once; rules whose consequent is one verdict item are kept, named by
    their sorted antecedent (`rule`). Rules rank by confidence, then support (both higher first), then fewer items,
    then name. A rule is dropped when a rule of the same verdict with one item less is at least as confident: that
    one fits wherever it does and ranks above it, so no verdict changes. `anchor` is the rule's rarest item (by
    support, then name), under which the inverted index files it.
    """
    transactions = labelled.select(F.array_union("items", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(transactions)
    rules = model.associationRules.filter(
        (F.size("consequent") == 1) & F.col("consequent")[0].startswith("verdict:")
        & ~F.exists("antecedent", lambda i: i.startswith("verdict:"))
    ).select(
        F.array_sort("antecedent").alias("items"), F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"),
        "confidence", "support",
    )
    rules = saved(rules.withColumn("rule", F.array_join("items", " ")), "url-all-rules")
    parents = rules.select(
        F.explode(F.transform("items", lambda i: F.array_join(F.array_remove("items", i), " "))).alias("parent_rule"),
        "rule", "verdict", "confidence",
    )
    covered = parents.join(
        rules.select(F.col("rule").alias("parent_rule"), "verdict", F.col("confidence").alias("parent_confidence")),
        ["parent_rule", "verdict"],
    ).filter(F.col("parent_confidence") >= F.col("confidence")).select("rule", "verdict").distinct()
    kept = rules.join(covered, ["rule", "verdict"], "left_anti")
    singles = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("item"), F.col("freq"))
    anchors = kept.select("rule", "verdict", F.explode("items").alias("item")).join(singles, "item").groupBy(
        "rule", "verdict"
    ).agg(F.min(F.struct("freq", "item"))["item"].alias("anchor"))
    return kept.join(anchors, ["rule", "verdict"]).select(
        "rule", "verdict", "items", F.size("items").alias("n_items"), "confidence", "support", "anchor"
    )


def judged(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, learned for every row of `pages` (page_id, url; other columns unread).

    `rule` is the longest fixed rule that fits, `verdict` its verdict; where none fits, the verdict of the mined rule
    of highest confidence, then support, then fewest items, then smallest name (`learned`, its items joined by spaces);
    where none of these fits either, `OTHERWISE`. A null or schemeless URL has empty host and path and is judged like
    any other. Everything is worked out once per distinct URL, and each distinct labelled URL is one transaction, so a
    URL on a third of all pages is one row until the final join (broadcast when the verdicts are small, else split
    by Spark's skew handling).
    """
    host, path = host_and_path("url")
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    urls = saved(urls.select("*", tokens(F.col("host"), F.col("path"), F.col("url")).alias("items"),
                             rule.alias("rule"), verdict.alias("fixed")), "url-tokens")
    labelled = urls.filter(F.col("rule").isNotNull()).select("items", F.col("fixed").alias("verdict"))
    rules = saved(mined_rules(labelled), "url-rules")
    # each rule is filed under its rarest item only, and checked whole against the URL's items
    index = lookup(rules.select(F.col("anchor").alias("item"), F.col("rule").alias("learned"),
                                F.col("items").alias("rule_items"), F.col("verdict").alias("mined"), "n_items",
                                "confidence", "support"), "learned")
    open_urls = urls.filter(F.col("rule").isNull()).select("url", "items", F.explode("items").alias("item"))
    fitting = open_urls.join(index, "item").filter(F.forall("rule_items", lambda i: F.array_contains("items", i)))
    key = F.struct(-F.col("confidence"), -F.col("support"), F.col("n_items"), F.col("learned").alias("learned"),
                   F.col("mined").alias("mined"))
    chosen = fitting.groupBy(F.col("url").alias("open_url")).agg(F.min(key).alias("best"))
    per_url = urls.join(chosen, F.col("url").eqNullSafe(F.col("open_url")), "left").select(
        "url", "host", "path", "rule", F.col("best.learned").alias("learned"),
        F.coalesce("fixed", "best.mined", F.lit(OTHERWISE)).alias("verdict"),
    )
    per_url = lookup(saved(per_url, "url-verdicts"), "url")
    return pages.select("page_id", F.col("url").alias("page_url")).join(
        per_url, F.col("page_url").eqNullSafe(F.col("url"))
    ).select("page_id", "host", "path", "rule", "verdict", "learned")
