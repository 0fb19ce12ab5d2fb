"""Synthetic traces from a model. Every draw is a hash of the seed, the trace and the place in its tree, so results
don't depend on partitions or retries. A level of all trees is two joins: with what can stand at a place, a row a place,
and with all that is known of a pair of features, a row a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import clamp, let, normal, uniform
from ..plans.storage import stored
from .draws import draw_table, drawn
from .model import PAIR_KEY, PERCENTILES, SLOT, Model

CANDIDATES = 100


def generated_roots(model: Model) -> DataFrame:
    """Every root of the start table as often as it was seen, with a start and a duration."""
    c = model.config
    start = model.tables["start"].select("bucket", "trace_type", "feature", "child_count", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i"))
    name = F.md5(F.concat_ws(":", F.lit(c.seed), "bucket", "trace_type", "feature", "child_count", "i"))
    return drawn_roots(start.withColumn("trace_id", name).drop("i"), model)


def drawn_roots(roots: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """Roots of known trace, feature and child count with a start and a duration; ``keep`` names columns to carry."""
    c = model.config
    meta = model.tables["bucket_meta"].select("bucket", "first_us", "last_us", "max_tree")
    roots = roots.join(meta, "bucket")
    mix = model.tables["root_durations"].drop("n")
    roots = roots.join(mix, ["bucket", "feature", "child_count"], "left")

    def draw(j: Column) -> Column:
        u = uniform("component", F.lit(c.seed), F.col("trace_id"), j)
        upto = F.aggregate("weights", F.array(F.lit(0.0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
        at = F.greatest(F.lit(0), F.size(F.filter(upto, lambda x: x < u)) - 1)
        at = F.least(at, F.size("weights") - 1)
        y = F.get("means", at) + F.sqrt(F.get("variances", at)) * normal(F.lit(c.seed), F.col("trace_id"), j)
        return F.expm1(F.least(y, F.lit(40.0)))

    if c.use_duration_bounds:
        # The first of so many draws that falls inside; later ones aren't made.
        inside = lambda x: F.when((x >= F.col("lo")) & (x <= F.col("hi")), x)
        first = F.aggregate(F.sequence(F.lit(1), F.lit(CANDIDATES)), F.lit(None).cast("double"), lambda found, j: F.when(found.isNotNull(), found).otherwise(let(draw(j), inside)))
        value = F.coalesce(first, (F.col("lo") + F.col("hi")) / 2.0)
    else:
        value = draw(F.lit(1))
    room = F.greatest(F.col("last_us") - F.col("first_us"), F.lit(1))
    return roots.select(
        "bucket", "trace_type", "trace_id", F.md5(F.concat_ws(":", "trace_id", F.lit("0"))).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"), F.lit("").alias("parent"), "feature", "child_count", F.lit("0").alias("path"), F.lit(0).cast("bigint").alias("depth"),
        (F.col("first_us") + F.floor(uniform("start", F.lit(c.seed), F.col("trace_id")) * room)).cast("bigint").alias("start_us"),
        F.greatest(F.lit(1), F.coalesce(value, F.lit(1.0)).cast("bigint")).alias("dur_us"), "max_tree", *keep,
    )


def place_table(model: Model) -> DataFrame:
    """What can stand at each place, ready to draw from."""
    return stored(draw_table(model.tables["edges"], list(SLOT), ["feature", "child_count"], "n", "_child"), "places")


def pair_table(model: Model, pairs: DataFrame) -> DataFrame:
    """All that is known of each of the pairs (bucket, parent, feature): samples that were memorised, the line or the
    percentiles of gaps and durations, and the bounds of the child's feature."""
    key = list(PAIR_KEY)
    memory = model.tables["pair_memorised"].groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "gap", "dur"))), lambda x: F.struct(x["gap"], x["dur"])).alias("memory"))
    fitted = "pair_regression" if model.config.offset_model == "regression" else "pair_percentiles"
    out = pairs.select(*key).distinct().join(memory, key, "left").join(model.tables[fitted].drop("n"), key, "left")
    for y, t in (("gap", "gap_bounds"), ("dur", "duration_bounds")):
        bounds = model.tables[t].select("bucket", "feature", F.col("lo").alias(f"{y}_lo"), F.col("hi").alias(f"{y}_hi"))
        out = out.join(bounds, ["bucket", "feature"], "left")
    return stored(out, "pairs")


def children_of(level: DataFrame, model: Model, places: DataFrame, pairs: DataFrame) -> DataFrame:
    """The next level: for every position under every node a child drawn from those seen there."""
    c = model.config
    slots = level.where("child_count > 0").select(
        "bucket", "trace_type", "trace_id", F.col("span_id").alias("parent_span_id"), F.col("feature").alias("parent"),
        F.col("child_count").alias("parent_count"), F.col("path").alias("_path"), F.col("start_us").alias("p_start"), F.col("dur_us").alias("p_dur"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("child_count"), F.lit(c.max_children)) - 1)).alias("position"), "depth", "max_tree",
    )
    s = slots.withColumn("path", F.concat_ws(".", "_path", "position")).join(places, list(SLOT))
    s = s.withColumn("_pick", drawn(uniform("child", F.lit(c.seed), F.col("trace_id"), F.col("path")), "_child")).drop("_child")
    return timed(s.withColumns({x: F.col("_pick")[x] for x in ("feature", "child_count")}), model, pairs)


def timed(s: DataFrame, model: Model, pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Gap and duration of each child relative to its parent, then bounds, then absolute times; ``keep`` names columns
    to carry."""
    c = model.config
    x = F.when(F.col("parent_count") > 1, F.col("position") / (F.col("parent_count") - 1)).otherwise(0.0)
    s = s.join(pairs, list(PAIR_KEY), "left")
    pick = F.floor(uniform("memory", F.lit(c.seed), F.col("trace_id"), F.col("path")) * F.size("memory")).cast("int")
    s = s.withColumn("_m", F.when(F.col("memory").isNotNull(), F.get("memory", pick)))
    if c.offset_model == "regression":
        fitted = {y: F.col(f"{y}_beta0") + F.col(f"{y}_beta1") * x for y in ("gap", "dur")}
    else:

        def between(y: str) -> Column:
            at = uniform(y, F.lit(c.seed), F.col("trace_id"), F.col("path")) * (len(PERCENTILES) - 1)
            lo = F.floor(at).cast("int")
            a, b = F.get(f"{y}_p", lo), F.get(f"{y}_p", F.least(lo + 1, F.lit(len(PERCENTILES) - 1)))
            return a + (b - a) * (at - lo)

        fitted = {y: between(y) for y in ("gap", "dur")}
    unseen = {y: 0.1 + 0.3 * uniform(f"unseen-{y}", F.lit(c.seed), F.col("trace_id"), F.col("path")) for y in ("gap", "dur")}
    value = {y: F.coalesce(F.col("_m")[y], fitted[y], unseen[y]) for y in ("gap", "dur")}
    if c.offset_value == "ratio":
        real = {y: clamp(v, F.lit(0.0), F.lit(1.0)) * F.col("p_dur") for y, v in value.items()}
    elif c.offset_model == "regression":
        real = {y: F.expm1(F.least(v, F.lit(40.0))) for y, v in value.items()}
    else:
        real = value
    known = F.col("_m").isNotNull()
    s = s.withColumns({f"_{y}": v for y, v in real.items()})
    for y in real if c.use_duration_bounds else ():
        free = known | F.col(f"{y}_lo").isNull()
        s = s.withColumn(f"_{y}", F.when(free, F.col(f"_{y}")).otherwise(clamp(F.col(f"_{y}"), F.col(f"{y}_lo").cast("double"), F.col(f"{y}_hi").cast("double"))))
    total = F.col("_gap") + F.col("_dur")
    squeeze = F.when(~known & (total > F.col("p_dur")) & (total > 0), F.col("p_dur") / total).otherwise(1.0)
    s = s.withColumn("_q", squeeze)
    return s.select(
        "bucket", "trace_type", "trace_id", F.md5(F.concat_ws(":", "trace_id", "path")).alias("span_id"), "parent_span_id", "parent", "feature", "child_count", "path",
        (F.col("depth") + 1).alias("depth"), (F.col("p_start") + F.floor(F.col("_gap") * F.col("_q"))).cast("bigint").alias("start_us"),
        F.greatest(F.lit(1), F.floor(F.col("_dur") * F.col("_q")).cast("bigint")).alias("dur_us"), "max_tree", *keep,
    )


def generate(model: Model) -> DataFrame:
    """Spans of synthetic traces: as many roots as were trained on, trees no larger than the largest seen."""
    if model.config.topology_mode == "template":
        return from_templates(model)
    places, pairs = place_table(model), pair_table(model, model.tables["edges"])
    level = stored(generated_roots(model), "generated")
    out = level
    for _ in range(model.config.max_depth):
        level = stored(children_of(level, model, places, pairs), "generated")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    # Places are numbers: the tenth child comes after the second.
    place = F.transform(F.split("path", r"\."), lambda x: x.cast("int"))
    breadth = W.partitionBy("trace_id").orderBy("depth", place)
    out = out.withColumn("_n", F.row_number().over(breadth)).where("_n <= max_tree")
    return with_attributes(out.drop("_n", "max_tree"), model)


def generated_counts(model: Model) -> DataFrame:
    """Per bucket the traces and spans that ``generate`` would return, without times and attributes: topology alone decides."""
    start = model.tables["start"] if model.config.topology_mode == "edge" else model.tables["templates"]
    if model.config.topology_mode == "template":
        return start.groupBy("bucket").agg(F.sum("n").alias("traces"), F.sum(F.col("n") * F.col("size")).alias("spans"))
    c, places = model.config, place_table(model)
    roots = start.select("bucket", "trace_type", "feature", "child_count", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i"))
    name = F.md5(F.concat_ws(":", F.lit(c.seed), "bucket", "trace_type", "feature", "child_count", "i"))
    level = stored(roots.select("bucket", "trace_type", name.alias("trace_id"), "feature", "child_count", F.lit("0").alias("path")), "counted")
    per = level.groupBy("bucket", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(c.max_depth):
        position = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("child_count"), F.lit(c.max_children)) - 1)).alias("position")
        s = level.where("child_count > 0").select("bucket", "trace_type", "trace_id", F.col("feature").alias("parent"), F.col("child_count").alias("parent_count"), "path", position)
        s = s.withColumn("path", F.concat_ws(".", "path", "position")).join(places, list(SLOT))
        pick = drawn(uniform("child", F.lit(c.seed), F.col("trace_id"), F.col("path")), "_child")
        level = stored(s.withColumn("_pick", pick).select("bucket", "trace_type", "trace_id", "_pick.feature", "_pick.child_count", "path"), "counted")
        if level.isEmpty():
            break
        per = per.unionByName(level.groupBy("bucket", "trace_id").agg(F.count(F.lit(1)).alias("n")))
    most = model.tables["bucket_meta"].select("bucket", "max_tree")
    per = per.groupBy("bucket", "trace_id").agg(F.sum("n").alias("n")).join(most, "bucket")
    return per.groupBy("bucket").agg(F.count(F.lit(1)).alias("traces"), F.sum(F.least("n", "max_tree")).alias("spans"))


def with_attributes(spans: DataFrame, model: Model) -> DataFrame:
    """Draw each dependent attribute from what its pair of features had; the parent's feature goes."""
    for d in model.config.dependent:
        t = draw_table(model.tables[f"attribute_{d}"], list(PAIR_KEY), ["value"], "n", "_value")
        s = spans.join(t, list(PAIR_KEY), "left")
        value = drawn(uniform(d, F.lit(model.config.seed), F.col("span_id")), "_value")["value"]
        spans = s.select(*[spans[c] for c in spans.columns], F.coalesce(value, F.lit("")).alias(d))
    return spans.drop("parent")


def template_edges(nodes: DataFrame) -> DataFrame:
    """From the nodes of templates in breadth-first order: tree, i and position of each parent's children. The children
    of a node follow those of the nodes before it."""
    before = F.sum("child_count").over(W.partitionBy("tree").orderBy("i")) - F.col("child_count")
    up = nodes.withColumn("_first", before + 1).where("child_count > 0")
    position = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("child_count") - 1)).alias("position")
    up = up.select("tree", F.col("i").alias("parent_i"), F.col("feature").alias("parent"), F.col("child_count").alias("parent_count"), "_first", position)
    return up.withColumn("i", F.col("_first") + F.col("position")).drop("_first").join(nodes, ["tree", "i"])


def from_templates(model: Model) -> DataFrame:
    """Exactly the trees that were seen, as often as they were seen, with drawn times and attributes."""
    c = model.config
    tree = F.md5(F.concat_ws(":", "bucket", "trace_type", F.to_json("nodes"))).alias("tree")
    t = stored(model.tables["templates"].select("bucket", "trace_type", tree, "nodes", "n"), "template_trees")
    nodes = t.select("tree", F.posexplode("nodes").alias("i", "node")).select("tree", F.col("i").cast("bigint").alias("i"), "node.feature", "node.child_count")
    edges = stored(template_edges(nodes), "template_edges")
    first = F.get("nodes", 0)
    roots = t.select("bucket", "trace_type", "tree", first["feature"].alias("feature"), first["child_count"].alias("child_count"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("seq"))
    roots = roots.withColumn("trace_id", F.md5(F.concat_ws(":", F.lit(c.seed), "tree", "seq"))).withColumn("i", F.lit(0).cast("bigint"))
    pairs = pair_table(model, t.select("bucket", "tree").join(edges.select("tree", "parent", "feature").distinct(), "tree"))
    level = stored(drawn_roots(roots, model, ("tree", "i")), "generated")
    out = level
    while True:
        up = level.where("child_count > 0").select(
            "bucket", "trace_type", "trace_id", "tree", F.col("i").alias("parent_i"), F.col("span_id").alias("parent_span_id"),
            F.col("path").alias("_path"), F.col("start_us").alias("p_start"), F.col("dur_us").alias("p_dur"), "depth", "max_tree",
        )
        s = up.join(edges, ["tree", "parent_i"]).withColumn("path", F.concat_ws(".", "_path", "position")).withColumnRenamed("i", "tree_i")
        level = stored(timed(s, model, pairs, ("tree", "tree_i")).withColumnRenamed("tree_i", "i"), "generated")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return with_attributes(out.drop("tree", "i", "max_tree"), model)
