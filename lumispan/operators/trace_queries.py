"""The questions asked of traces: rate, errors, latency, dependencies, tree sizes, data-set profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import PAIR, group_entries, group_keys, span_entries
from ..plans.storage import stored
from ..schema import PRIMARY
from .numbering import numbered
from .tree import positioned, rooted, with_parent


def _keyed(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row per group key of each row. Callers aggregate by the columns first, so what is multiplied is
    the number of distinct signatures, not of spans."""
    return df.withColumn("group_key", F.explode(group_keys(group_entries({c: F.col(c) for c in columns})))).drop(*columns)


def entry_counts(spans: DataFrame, by: list[str], columns: tuple[str, ...], attributes: tuple[str, ...] | None) -> DataFrame:
    """Spans per ``by`` and set of column:value entries."""
    entries = span_entries({c: F.col(c) for c in columns}, F.col("attrs"), attributes).alias("entries")
    return spans.select(*by, entries).groupBy(*by, "entries").agg(F.count(F.lit(1)).alias("n"))


def keyed_sums(counts: DataFrame, by: list[str]) -> DataFrame:
    """From ``entry_counts``: n summed per group key and ``by``.

    Entries are numbered in their order, once, and keys are pairs of numbers until they have been summed: what is
    multiplied is the number of distinct sets, and what is shuffled are integers.
    """
    sets = stored(counts.withColumn("_set", F.monotonically_increasing_id()), "entry_sets")
    each = sets.select("_set", F.explode("entries").alias("entry"))
    dictionary = stored(numbered(each.select("entry").distinct(), ["entry"], "id"), "entries")
    coded = each.join(dictionary, "entry").groupBy("_set").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    none = F.lit(-1).cast("bigint")
    key = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    pairs = F.flatten(F.transform(ids, lambda a, i: F.transform(F.slice(ids, i + 2, F.greatest(F.size(ids) - i - 1, F.lit(0))), lambda b: key(a, b))))
    keys = F.concat(F.array(key(none, none)), F.transform(ids, lambda a: key(a, none)), pairs)
    rows = sets.join(coded, "_set", "left").select(*by, "n", F.explode(keys).alias("k"))
    sums = rows.groupBy(*by, "k.a", "k.b").agg(F.sum("n").alias("n"))
    name = lambda x: dictionary.select(F.col("id").alias(x), F.col("entry").alias(f"_{x}"))
    sums = sums.join(name("a"), "a", "left").join(name("b"), "b", "left")
    text = F.when(F.col("a") < 0, "all").when(F.col("b") < 0, F.col("_a")).otherwise(F.concat("_a", F.lit(PAIR), "_b"))
    return sums.select(text.alias("group_key"), *by, "n")


def rate_over_time(spans: DataFrame, time: str = "bucket", columns: tuple[str, ...] = PRIMARY, attributes: tuple[str, ...] | None = ()) -> DataFrame:
    """Spans per group key and time. Keys name columns and, where ``attributes`` says so, attributes; None is all of them."""
    if attributes != ():
        return keyed_sums(entry_counts(spans, [time], columns, attributes), [time])
    counts = spans.groupBy(time, *columns).agg(F.count(F.lit(1)).alias("n"))
    return _keyed(counts, columns).groupBy("group_key", time).agg(F.sum("n").alias("n"))


def totals(rates: DataFrame) -> DataFrame:
    return rates.groupBy("group_key").agg(F.sum("n").alias("n"))


def errors_over_time(spans: DataFrame, time: str = "bucket", columns: tuple[str, ...] = PRIMARY, attributes: tuple[str, ...] | None = ()) -> DataFrame:
    return rate_over_time(spans.where(F.col("status") == "2"), time, columns, attributes)


def durations_over_time(
    spans: DataFrame, time: str = "bucket", columns: tuple[str, ...] = PRIMARY, probabilities: tuple[float, ...] = (0.5, 0.9, 0.99),
    attributes: tuple[str, ...] | None = (),
) -> DataFrame:
    """Exact interpolated percentiles of the durations per group key and time.

    Durations are counted per signature before keys are expanded, and percentiles read counts, so
    the group 'all' holds distinct durations, not spans.
    """
    if attributes != ():
        counts = keyed_sums(entry_counts(spans, [time, "dur_us"], columns, attributes), [time, "dur_us"])
    else:
        counts = spans.groupBy(time, *columns, "dur_us").agg(F.count(F.lit(1)).alias("n"))
        counts = _keyed(counts, columns).groupBy("group_key", time, "dur_us").agg(F.sum("n").alias("n"))
    values = F.percentile("dur_us", F.array(*[F.lit(p) for p in probabilities]), F.col("n"))
    out = counts.groupBy("group_key", time).agg(values.alias("v"), F.sum("n").alias("n"))
    return out.select("group_key", time, "n", *[F.get("v", i).alias(f"p{p * 100:g}".replace(".", "_")) for i, p in enumerate(probabilities)])


def node_name() -> F.Column:
    return F.when(F.coalesce("operation", F.lit("")) == "", F.col("service")).otherwise(F.concat_ws("/", "service", "operation"))


def graph_edges(spans: DataFrame, time: str = "bucket") -> DataFrame:
    """Calls per time of the child: parent node, child node, weight."""
    s = with_parent(spans.withColumn("node", node_name()), ["node"], "inner")
    return s.groupBy(time, F.col("p_node").alias("parent"), F.col("node").alias("child")).agg(F.count(F.lit(1)).alias("weight"))


def graph_nodes(spans: DataFrame, time: str = "bucket") -> DataFrame:
    return spans.select(time, node_name().alias("node")).distinct()


def flat_spans(spans: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Spans with what stands around them: depth, parent's names, siblings, start offset in the trace; and a column for each
    of the ``attributes``, '' where a span hasn't got it."""
    p = with_parent(positioned(spans).drop("p_span_id"), ["service", "operation"])
    p = p.join(rooted(spans).select("trace_id", "span_id", "depth"), ["trace_id", "span_id"])
    return p.select(
        "trace_id", "span_id", "parent_span_id", "service", "operation", "kind", "status", "start_us", "dur_us", "depth",
        F.coalesce("p_service", F.lit("")).alias("parent_service"),
        F.coalesce("p_operation", F.lit("")).alias("parent_operation"),
        "siblings", "bucket", (F.col("start_us") - F.col("trace_start")).alias("start_offset_us"),
        *[F.coalesce(F.col("attrs")[a], F.lit("")).alias(a) for a in attributes],
    )


def basics(spans: DataFrame) -> DataFrame:
    """Spans, traces, services, and the window that they span."""
    end = F.max(F.col("start_us") + F.col("dur_us"))
    return spans.agg(
        F.count(F.lit(1)).alias("spans"),
        F.countDistinct("trace_id").alias("traces"),
        F.countDistinct("service").alias("services"),
        F.min("start_us").alias("first_us"),
        (end - F.min("start_us")).alias("window_us"),
    )


def column_stats(spans: DataFrame, columns: tuple[str, ...] = PRIMARY) -> DataFrame:
    """Per column and attribute: spans that have it, distinct values, share of spans."""
    fixed = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    extra = F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    values = spans.select(F.explode(F.concat(fixed, extra)).alias("x")).where("x.value <> ''")
    total = spans.agg(F.count(F.lit(1)).alias("_total"))  # one row
    per = values.groupBy("x.name", "x.value").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("name").agg(F.sum("n").alias("spans"), F.count(F.lit(1)).alias("distinct_values"))
    return per.crossJoin(F.broadcast(total)).select("name", "spans", "distinct_values", (F.col("spans") / F.col("_total")).alias("coverage"))


def child_sets(spans: DataFrame) -> DataFrame:
    """Per parent feature: parents that occur as leaves, with one child, or with a varying number; the share of
    its commonest set of child features, as a set and as a multiset."""
    p = with_parent(spans, ["feature"], "inner")
    kids = p.groupBy("trace_id", "p_span_id", "p_feature").agg(F.array_sort(F.collect_list("feature")).alias("kids"))
    kids = kids.select("p_feature", F.array_join("kids", "\x01").alias("multi"), F.array_join(F.array_distinct("kids"), "\x01").alias("once"), F.size("kids").alias("n"))
    total = kids.groupBy("p_feature").agg(
        F.count(F.lit(1)).alias("parents"), F.min("n").alias("fewest"), F.max("n").alias("most")
    )
    top = lambda c: kids.groupBy("p_feature", c).agg(F.count(F.lit(1)).alias("k")).groupBy("p_feature").agg(F.max("k").alias(f"top_{c}"))
    joined = total.join(top("multi"), "p_feature").join(top("once"), "p_feature")
    return joined.select(
        F.col("p_feature").alias("feature"), "parents", "fewest", "most",
        F.when(F.col("most") == 1, "single").otherwise("variable").alias("relay"),
        (F.col("top_once") / F.col("parents")).alias("top_set_share"),
        (F.col("top_multi") / F.col("parents")).alias("top_multiset_share"),
    )


def relay_types(spans: DataFrame) -> DataFrame:
    """One row: features, how many of them never have a child, have one at most, or may have several, their shares in
    percent; and of the last, how many have one set (multiset) of child features in over half of their calls with
    children, of two such calls or more."""
    kinds = child_sets(spans).select("feature", "parents", "most", "top_set_share", "top_multiset_share")
    rows = spans.select("feature").distinct().join(kinds, "feature", "left").withColumn("most", F.coalesce("most", F.lit(0)))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    often = (F.col("most") > 1) & (F.col("parents") >= 2)
    out = rows.agg(
        F.count(F.lit(1)).alias("types"), count(F.col("most") == 0).alias("leaf"), count(F.col("most") == 1).alias("single"), count(F.col("most") > 1).alias("variable"),
        count(often & (F.col("top_set_share") > 0.5)).alias("one_set"), count(often & (F.col("top_multiset_share") > 0.5)).alias("one_multiset"),
    )
    share = lambda c: (F.when(F.col("types") > 0, F.col(c) * 100.0 / F.col("types")).otherwise(0.0)).alias(f"{c}_percent")
    return out.select("*", share("leaf"), share("single"), share("variable"))


def volume(spans: DataFrame, size: Column) -> DataFrame:
    """One row: bytes, the window of the starts in seconds, TiB a day at that rate, and dollars a month of 30 days at 0.10 a
    GiB; no rate where there is no window."""
    v = spans.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce((F.max("start_us") - F.min("start_us")) / 1e6, F.lit(0.0)).alias("window_s"))
    v = v.withColumn("tib_a_day", F.when(F.col("window_s") > 0, F.col("bytes") / F.col("window_s") * 86_400 / float(1 << 40)))
    return v.withColumn("dollars_a_month", F.col("tib_a_day") * 1024 * 30 * 0.10)


def orphan_stats(spans: DataFrame) -> DataFrame:
    """Share of spans that name a missing parent, and of traces without such a span."""
    orphan = (F.col("parent_span_id").isNotNull() & ~F.col("has_parent")).cast("int")
    per = spans.groupBy("trace_id").agg(F.sum(orphan).alias("o"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        (100.0 * F.sum("o") / F.sum("n")).alias("orphan_percent"),
        (100.0 * F.avg((F.col("o") == 0).cast("int"))).alias("complete_percent"),
    )
