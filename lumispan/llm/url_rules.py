"""URL filters: given rules by host and path, and association rules mined from labelled URLs.

A given rule fits its host and all subdomains where the path starts with the rule's; the longest wins. What no given
rule decides is judged by mined rules: URLs are sets of tokens (host suffixes and host words, path words, extension,
parameter names), Spark's FP-growth finds the token sets that are frequent among labelled URLs, and those that imply a
label with enough confidence and support become rules. An inverted index holds each rule under its rarest token, so a
URL meets only the rules that one of its tokens leads to; a rule matches where the URL has all its tokens. The most
confident match decides, then the best supported, then the one with fewer tokens, then the first in order; where nothing
matches, the URL is allowed.

Labels are a table of URLs with a label, mined over all its rows. ``judged`` labels by its own given rules: the URLs that
they decide are the sample that the mined rules extend to hosts and paths that no rule names. Frequent sets grow with
1/``min_support``, not with the rows. Each distinct URL is judged once, and tokens meet the index by a shuffle whose hot
keys Spark can split; no table is broadcast or collected.

Edge cases: a null URL, or one without ``://``, has an empty host and path, no tokens, and is allowed; an empty URL
likewise; very long URLs keep all their tokens; repeated rows are kept apart and judged alike; ties between rules end as
stated above; without labels nothing is mined and what no given rule decides is allowed; an empty table gives no rows;
extra columns are dropped, whatever they are called.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict) of the given rules.
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))
#: Of the labelled URLs, the share that a rule must hold for, of those with its tokens, the share in a hundred that must
#: have its label, and the most tokens of a rule.
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.01, 80, 3
#: What marks the item of a label among tokens, which all start with a letter and a colon.
LABEL = "="


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest given rule that fits, as a struct of rule and verdict; null where none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule string, verdict string>")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, sorted: ``s:`` for suffixes of the host, ``h:`` for its words, ``p:`` for words of
    the path, ``e:`` for an extension, ``q:`` for parameter names. Words without a letter, as numbers of articles, are left out."""
    word = lambda v: v.rlike("[^0-9]")
    named = lambda kind, items: F.transform(F.filter(items, word), lambda v: F.concat(F.lit(kind), v))
    labels = F.split(host, r"\.")
    suffixes = let(labels, lambda a: F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.array_join(F.slice(a, i, F.size(a)), ".")))
    low = _ascii_lower(path)
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    parameters = F.transform(F.split(query, "&"), lambda v: F.regexp_extract(v, "^[^=]*", 0))
    return F.array_sort(F.array_distinct(F.concat(
        named("s:", suffixes), named("h:", F.split(host, r"[.\-_]")), named("p:", F.split(low, r"[/.\-_]")),
        named("e:", F.array(F.regexp_extract(low, r"\.([a-z0-9]+)$", 1))), named("q:", parameters),
    )))


def mined_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: int = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """From (tokens, label): tokens, label, held (rows with all tokens and the label), seen (with all tokens), confidence."""
    items = labelled.where(F.col("label").isNotNull()).select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    items = written(items, "url-items")
    kinds = "tokens array<string>, label string, held bigint, seen bigint, confidence double"
    if items.isEmpty():
        return items.sparkSession.createDataFrame([], kinds)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence / 100).fit(items)
    of_label = F.filter("items", lambda v: v.startswith(LABEL))
    others = F.array_sort(F.filter("items", lambda v: ~v.startswith(LABEL)))
    sets = model.freqItemsets.select(others.alias("tokens"), of_label.alias("of"), "freq").where(F.size("tokens").between(1, max_tokens))
    sets = written(sets, "url-sets")
    seen = sets.where(F.size("of") == 0).select("tokens", F.col("freq").alias("seen"))
    held = sets.where(F.size("of") == 1).select("tokens", F.substring(F.col("of")[0], 2, 1 << 30).alias("label"), F.col("freq").alias("held"))
    return (
        held.join(seen, "tokens")
        .where(F.col("held") * 100 >= F.col("seen") * min_confidence)
        .select("tokens", "label", "held", "seen", (F.col("held") / F.col("seen")).alias("confidence"))
    )


def inverted_index(rules: DataFrame) -> DataFrame:
    """Each rule under its rarest token: token, and the rule as a struct whose least is the best."""
    one = rules.where(F.size("tokens") == 1).groupBy(F.col("tokens")[0].alias("token")).agg(F.max("seen").alias("n"))
    each = rules.select("*", F.explode("tokens").alias("token")).join(one, "token", "left")
    rule = F.struct(
        (-F.col("confidence")).alias("confidence"), (-F.col("held")).alias("held"), F.size("tokens").alias("size"),
        "tokens", "label",
    )
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
    return each.groupBy("tokens", "label").agg(rarest.alias("token"), F.first(rule).alias("rule")).select("token", "rule")


def matched(urls: DataFrame, index: DataFrame) -> DataFrame:
    """From distinct (url, tokens): url and label of the best rule whose tokens it has; URLs without one are left out."""
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    met = met.where(F.size(F.array_except(F.col("rule.tokens"), "tokens")) == 0)
    return met.groupBy("url").agg(F.min("rule").alias("rule")).select("url", F.col("rule.label").alias("label"))


def judged(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. ``labels`` (url, label) is what rules are mined from; without it, the
    URLs that the given rules decide, with their verdicts."""
    rows = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("given", rule_of(F.col("host"), F.col("path"), rules))
    parsed = lambda df: df.withColumn("tokens", tokens_of(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))))
    known = rows.where("given is not null").select("url", F.col("given.verdict").alias("label")) if labels is None else labels
    index = written(inverted_index(mined_rules(parsed(known.select("url", "label")))), "url-index")
    open_urls = rows.where("given is null and url is not null").select("url").distinct()
    found = matched(parsed(open_urls), index).select(F.col("url").alias("_url"), "label")
    open_ = F.col("given").isNull() & F.col("url").isNotNull()
    verdict = F.coalesce("given.verdict", "label", F.lit(ALLOW))
    columns = ["page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict")]
    decided = rows.where(~open_).withColumn("label", F.lit(None).cast("string"))
    rest = rows.where(open_).join(found, F.col("url") == F.col("_url"), "left")
    return decided.select(*columns).unionByName(rest.select(*columns))
