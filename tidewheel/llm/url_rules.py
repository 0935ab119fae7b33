"""URL filter: explicit host and path rules first, then association rules mined from the urls that they judge.

SQL functions and Spark's FP-growth only. Transactions are the tokens of a url plus its verdict; rules with a verdict
as consequent, pruned by support and confidence and by simpler rules at least as sure, are looked up through an index
from token to rule. Equal token sets are judged once, so a hot host costs one look-up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import ascii_lower, stash


#: Parts that the urls of one token set are dealt over when they learn its verdict.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str  # begins with /

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; path: then up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url__, instr(url__, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def fitting(rules: list[Rule]) -> Column:
    """The longest rule that fits host and path, as struct(n, rule, verdict); null without one. The list is small."""
    out = []
    for r in rules:
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out.append(F.when(fits, F.struct(F.lit(len(r.text)).alias("n"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    out.append(F.lit(None).cast("struct<n:int,rule:string,verdict:string>"))
    return F.greatest(*out, out[-1])


def tokens() -> Column:
    """Distinct tokens of scheme, host suffixes, first label, first folder, file ending and query keys, in order."""
    label = "split(host, '[.]')"
    expr = f"""array_sort(array_distinct(filter(concat(
        array(concat('scheme:', lower(regexp_extract(url__, '^([A-Za-z]+)://', 1))), concat('first:', element_at({label}, 1)),
              concat('top:', substring_index(host, '.', -1)), concat('site:', substring_index(host, '.', -2)),
              concat('folder:', regexp_replace(regexp_extract(path, '^/([^/]+)/', 1), '[0-9]+', '0')),
              concat('ending:', regexp_extract(path, '[.]([A-Za-z0-9]{{1,5}})$', 1)), concat('slash:', if(endswith(path, '/'), 'end', ''))),
        transform(regexp_extract_all(regexp_extract(url__, '[?]([^#]*)', 1), '([^&=]+)=?[^&]*', 1), k -> concat('key:', lower(k)))
    ), t -> t IS NOT NULL AND t NOT LIKE '%:')))"""
    return F.expr(expr)


def mine(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """rule_id, antecedent, verdict, confidence, support from labelled(tokens, verdict): all rules but those that a
    simpler rule of the same verdict, at least as sure, covers."""
    baskets = labelled.where("size(tokens) > 0").select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], "rule_id long, antecedent array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.select(
        F.array_sort("antecedent").alias("antecedent"), F.element_at("consequent", 1).alias("c"), "confidence", "support"
    ).where("c LIKE 'verdict:%' AND NOT exists(antecedent, t -> t LIKE 'verdict:%')").select("antecedent", F.expr("substring(c, 9)").alias("verdict"), "confidence", "support")
    found = stash(found, "rules")
    parts = "aggregate(antecedent, array(cast(array() AS array<string>)), (acc, t) -> concat(acc, transform(acc, s -> concat(s, array(t)))))"
    simpler = found.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("c"))
    part = found.select("antecedent", "verdict", "confidence", F.explode(F.expr(f"filter({parts}, s -> size(s) between 1 and size(antecedent) - 1)")).alias("part"))
    covered = part.join(simpler, ["part", "verdict"]).where("c >= confidence").select("antecedent", "verdict").distinct()
    kept = found.join(covered, ["antecedent", "verdict"], "left_anti")
    return stash(kept.select(F.monotonically_increasing_id().alias("rule_id"), "antecedent", "verdict", "confidence", "support"), "rules")


def filter_urls(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", support: float = 0.005, confidence: float = 0.6, default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict for every row of pages(url).

    A url that an explicit rule fits (its host and all subdomains, path prefix; the longest wins) gets the rule's
    verdict; the others that of the surest association rule whose tokens they hold, or `default`. Null urls and those
    without :// have an empty host and path and get `default`, or a rule of the scheme-less tokens. Repeated rows are
    judged alike, an empty table gives no rows; other columns of any name are ignored."""
    host, path = host_and_path(F.col("url__"))
    p = pages.select(F.col(id_column).alias("id__"), F.col("url").alias("url__")).withColumns({"host": host, "path": path}).withColumns({"fit": fitting(rules), "tokens": tokens()})
    mined = mine(p.where("fit is not null").select("tokens", F.col("fit.verdict").alias("verdict")), support, confidence)
    index = mined.select("rule_id", F.size("antecedent").alias("need"), F.explode("antecedent").alias("t"))
    sets = p.where("fit is null").select("tokens").distinct()
    held = sets.select("tokens", F.explode("tokens").alias("t")).join(index, "t").groupBy("tokens", "rule_id", "need").agg(F.count("*").alias("n")).where("n = need")
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (-F.col("need")).alias("n"), "antecedent", "verdict")
    best = held.join(mined, "rule_id").groupBy("tokens").agg(F.min_by("verdict", order).alias("mined"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # the urls of a hot template meet it in many tasks
    p = p.withColumn("salt", F.pmod(F.xxhash64("url__"), F.lit(SALTS)).cast("int"))
    return p.join(best, ["tokens", "salt"], "left").select(F.col("id__").alias(id_column), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "mined", F.lit(default)).alias("verdict"))
