"""DuckDB SQL for the registered queries, written from their definitions apart from the operators."""

from __future__ import annotations

DAY = 86_400_000_000
INJECT = 1_705_276_800_000_000

_SPANS = f"""
e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, epoch_us(ts) // {DAY} AS day,
             json_extract(props, '$.k')::int AS k FROM events),
r AS (SELECT *, row_number() OVER t AS rn, count(*) OVER (PARTITION BY user_id, day) AS cnt FROM e
      WINDOW t AS (PARTITION BY user_id, day ORDER BY us, event_id)),
b AS (SELECT user_id || '-' || day AS trace_id, user_id || '-' || day || '-' || rn AS span_id,
             CASE WHEN rn > 1 THEN user_id || '-' || day || '-' || (rn // 2) END AS parent_span_id,
             event_type AS service, 'k' || (k // 10) AS operation, CASE WHEN 2 * rn > cnt THEN 'CLIENT' ELSE 'SERVER' END AS kind,
             CASE WHEN event_type = 'error' THEN '2' ELSE '0' END AS status, us AS start_us, round(value * 1000)::bigint AS dur_us,
             k::varchar AS k, day AS bucket FROM r),
s AS (SELECT b.*, parent_span_id IS NOT NULL AS has_parent, max(status) OVER (PARTITION BY trace_id) = '2' AS error_trace,
             min(start_us) OVER (PARTITION BY trace_id) AS trace_start,
             'kind=' || kind || ';operation=' || operation || ';service=' || service || ';status=' || status AS feature,
             CASE WHEN max(status) OVER (PARTITION BY trace_id) = '2' THEN 'error' ELSE 'normal' END AS trace_type,
             service || '/' || operation AS node FROM b)
"""
# Positions and counts of children.
_TREE = """
kids AS (SELECT trace_id, parent_span_id, count(*) AS c FROM s WHERE parent_span_id IS NOT NULL GROUP BY ALL),
a AS (SELECT s.*, coalesce(kids.c, 0) AS child_count,
             CASE WHEN has_parent THEN row_number() OVER w - 1 ELSE 0 END AS position,
             CASE WHEN has_parent THEN count(*) OVER (PARTITION BY s.trace_id, s.parent_span_id) ELSE 0 END AS siblings
      FROM s LEFT JOIN kids ON s.trace_id = kids.trace_id AND s.span_id = kids.parent_span_id
      WINDOW w AS (PARTITION BY s.trace_id, s.parent_span_id ORDER BY s.start_us, s.span_id)),
x AS (SELECT c.*, p.feature AS p_feature, p.start_us AS p_start, p.dur_us AS p_dur, p.node AS p_node, p.service AS p_service,
             CASE WHEN c.siblings > 1 THEN c.position::double / (c.siblings - 1) ELSE 0 END AS np
      FROM a c JOIN a p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id)
"""
_DEPTH = """
tree AS (SELECT trace_id, span_id, span_id AS root, 0::bigint AS depth, lpad('0', 4, '0') AS path FROM a WHERE NOT has_parent
         UNION ALL SELECT a.trace_id, a.span_id, t.root, t.depth + 1, t.path || '/' || lpad(a.position::varchar, 4, '0')
         FROM tree t JOIN a ON a.trace_id = t.trace_id AND a.parent_span_id = t.span_id)
"""
_UP = """
up AS (SELECT trace_id, span_id, parent_span_id AS ancestor, 1::bigint AS distance FROM s WHERE has_parent
       UNION ALL SELECT u.trace_id, u.span_id, s.parent_span_id, u.distance + 1 FROM up u JOIN s ON s.trace_id = u.trace_id AND s.span_id = u.ancestor
       WHERE s.parent_span_id IS NOT NULL)
"""
_ENTRIES = "list_sort(['kind:' || kind, 'operation:' || operation, 'service:' || service, 'status:' || status])"
_KEYS = """
g AS (SELECT *, {entries} AS en FROM {source}),
kx AS (SELECT bucket, dur_us, unnest(['all'] || en || [en[1] || '!@#' || en[2], en[1] || '!@#' || en[3], en[1] || '!@#' || en[4],
       en[2] || '!@#' || en[3], en[2] || '!@#' || en[4], en[3] || '!@#' || en[4]]) AS group_key FROM g)
"""
_ATTRIBUTE_ENTRIES = "list_sort(['kind:' || kind, 'operation:' || operation, 'service:' || service, 'status:' || status, 'k:' || k])"
_HEAD = "('0x' || substr(md5('head:42:' || trace_id), 1, 8))::bigint < 4294967296 // {n}"
_ERROR = "CASE WHEN {a} > 0 THEN abs({a} - {b}) / ({a} + {b}) * 100.0::double WHEN {a} = 0 AND {b} = 0 THEN 0 ELSE 100 END"


def _q(body: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([_SPANS, *parts])} {body}"


def _keys(source: str = "s") -> str:
    return _KEYS.format(entries=_ENTRIES, source=source)


def _tree(body: str, *parts: str, recursive: bool = False) -> str:
    return _q(body, _TREE, *parts, recursive=recursive)


def any_keys(entries: str, source: str = "s", columns: str = "bucket, dur_us", name: str = "kx") -> str:
    """Keys of any number of entries: all, each, and each pair in order."""
    return f"""g_{name} AS (SELECT *, {entries} AS en FROM {source}),
    {name} AS (SELECT {columns}, unnest(['all'] || en || flatten(list_transform(range(1, len(en) + 1), lambda i: list_transform(en[i + 1:], lambda b: en[i] || '!@#' || b)))) AS group_key FROM g_{name})"""


def _base_head(value: str, where: str = "TRUE", n: int = 4, scale: float = 1.0, name: str = "", entries: str = "") -> str:
    """Series of the base and of the sample, and their report, as CTEs."""
    if entries:
        keys = lambda src: any_keys(entries, src, name=f"kx_{src}{name}")
    else:
        keys = lambda src: _KEYS.format(entries=_ENTRIES, source=src).replace("g AS", f"g_{src}{name} AS").replace("kx AS", f"kx_{src}{name} AS").replace("FROM g)", f"FROM g_{src}{name})")
    head = _HEAD.format(n=n)
    return f"""
    base{name} AS (SELECT * FROM s WHERE {where}), other{name} AS (SELECT * FROM s WHERE {where} AND {head}),
    {keys('base' + name)}, {keys('other' + name)},
    vb{name} AS (SELECT group_key, bucket, {value} AS v, count(*) AS w FROM kx_base{name}{name} GROUP BY ALL),
    vo{name} AS (SELECT group_key, bucket, {value} * {scale}::double AS o FROM kx_other{name}{name} GROUP BY ALL),
    rep{name} AS (SELECT vb{name}.group_key, avg(CASE WHEN o IS NOT NULL THEN {_ERROR.format(a='v::double', b='o::double')} END) AS m, sum(w)::bigint AS weight, sum(v) AS sv
        FROM vb{name} LEFT JOIN vo{name} USING (group_key, bucket) GROUP BY vb{name}.group_key),
    report{name} AS (SELECT group_key, coalesce(m, 100) AS mape, CASE WHEN m IS NULL THEN 0 ELSE greatest(0, 100 - m) END AS fidelity, weight FROM rep{name})
    """


def _durations() -> str:
    parts = [_SPANS]
    out = []
    for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        parts.append(_base_head(f"quantile_cont(dur_us, {q})", name=f"_{p}"))
        out.append(f"SELECT group_key, round(mape, 6) AS mape, round(fidelity, 6) AS fidelity, '{p}' AS percentile FROM report_{p}")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


def _graph(binary: bool) -> str:
    base, other = ("1.0", "1.0") if binary else ("count(*)::double", "count(*) * 4.0::double")
    head = _HEAD.format(n=4)
    return _tree(
        """, ed AS (SELECT bucket, sum(abs(coalesce(wa, 0) - coalesce(wb, 0))) AS e, sum(coalesce(wa, 0)) AS w FROM ea FULL JOIN eb USING (bucket, p_node, node) GROUP BY bucket)
        , nd AS (SELECT bucket, sum((na.node IS NULL OR nb.node IS NULL)::int) AS n, count(na.node) AS m, count(nb.node) AS has
                 FROM na FULL JOIN nb USING (bucket, node) GROUP BY bucket)
        SELECT bucket, round((n + coalesce(e, 0))::double, 6) AS distance,
          round(CASE WHEN has = 0 THEN 0 ELSE greatest(0, 100 - 100 * (n + coalesce(e, 0))::double / (m + coalesce(w, 0))) END, 6) AS fidelity
        FROM nd LEFT JOIN ed USING (bucket) WHERE m > 0""".lstrip(", "),
        f"ea AS (SELECT bucket, p_node, node, {base}::double AS wa FROM x GROUP BY ALL)",
        f"eb AS (SELECT bucket, p_node, node, {other}::double AS wb FROM x WHERE {head} GROUP BY ALL)",
        "na AS (SELECT DISTINCT bucket, node FROM s)",
        f"nb AS (SELECT DISTINCT bucket, node FROM s WHERE {head})",
    ).replace(") ed AS", "), ed AS").replace(")  ed AS", "), ed AS")


_SAMPLES = """
ps AS (SELECT bucket, p_feature AS parent, feature, np AS px, greatest(0, least(1, (start_us - p_start)::double / p_dur)) AS gap,
              greatest(0, least(1, dur_us::double / p_dur)) AS dur, k FROM x WHERE p_dur > 0
       UNION ALL SELECT bucket, '', feature, 0, 0, 1, k FROM a WHERE NOT has_parent)
"""
_SIGNALS = """
sig AS (SELECT service, bucket, avg(dur_us) AS m, quantile_cont(dur_us, 0.95) AS q FROM s GROUP BY ALL),
ser AS (SELECT service, 'mean' AS signal, bucket AS t, ln(m) AS v FROM sig WHERE m > 0 UNION ALL SELECT service, 'p95', bucket, ln(q) FROM sig WHERE q > 0),
num AS (SELECT *, row_number() OVER (PARTITION BY service, signal ORDER BY t) AS i FROM ser),
bas AS (SELECT service, signal, avg(v) AS m, stddev_samp(v) AS sd FROM num WHERE i <= 11 GROUP BY ALL HAVING stddev_samp(v) > 0 AND count(*) = 11),
z AS (SELECT num.service, num.signal, t, i, (v - m) / sd AS z FROM num JOIN bas USING (service, signal) WHERE i > 11),
cs AS (SELECT service, signal, t, i, greatest(0, z - 0.5) AS u, least(0, z + 0.5) AS d FROM z WHERE i = 12
       UNION ALL SELECT z.service, z.signal, z.t, z.i, greatest(0, CASE WHEN greatest(c.u, -c.d) > 5 THEN 0 ELSE c.u END + z - 0.5),
              least(0, CASE WHEN greatest(c.u, -c.d) > 5 THEN 0 ELSE c.d END + z + 0.5)
       FROM cs c JOIN z ON z.service = c.service AND z.signal = c.signal AND z.i = c.i + 1),
cu AS (SELECT service, signal, t AS time, u AS up, d AS down, greatest(u, -d) AS size, greatest(u, -d) > 5 AS alarm FROM cs)
"""
_LOCALISED = """
al AS (SELECT * FROM cu WHERE alarm),
lo AS (SELECT service, row_number() OVER (ORDER BY round(max(size), 9) DESC, service) AS rk FROM al GROUP BY service)
"""


def detected(day: int) -> str:
    """One row: what an injection at a day has of the alarms; nothing where the day lies outside the spans' days."""
    hits = ", ".join(f"coalesce((SELECT rk <= {k} FROM lo WHERE service = 'error'), false)::int AS ac{k}" for k in range(1, 6))
    return f"""SELECT fa, known AND coalesce(fa >= {day} - 1, false) AS detected, CASE WHEN known AND fa >= {day} - 1 THEN fa - {day} END AS delay,
        CASE WHEN known THEN early ELSE 0 END AS false_alarms, CASE WHEN known AND {day} > d0 THEN early::double / ({day} - d0) ELSE 0 END AS false_alarm_rate, {hits}
        FROM (SELECT (SELECT min(time) FROM al) AS fa, (SELECT count(*) FROM al WHERE time < {day} - 1) AS early, min(bucket) AS d0, {day} BETWEEN min(bucket) AND max(bucket) AS known FROM s)"""


_KS = f"""
f AS (SELECT service, dur_us, 0 AS side FROM s WHERE start_us >= {INJECT} UNION ALL SELECT service, dur_us, 1 FROM s WHERE start_us < {INJECT}),
o AS (SELECT service, side, row_number() OVER (PARTITION BY service ORDER BY dur_us, side) AS rn,
             sum((side = 0)::int) OVER (PARTITION BY service) AS na, sum((side = 1)::int) OVER (PARTITION BY service) AS nb,
             sum((side = 0)::int) OVER w AS iu, sum((side = 1)::int) OVER w AS ju FROM f
      WINDOW w AS (PARTITION BY service ORDER BY dur_us, side ROWS UNBOUNDED PRECEDING)),
st AS (SELECT service, na, nb, iu - (side = 0)::int AS i, ju - (side = 1)::int AS j FROM o WHERE na > 0 AND nb > 0),
ks AS (SELECT service, max(CASE WHEN i < na AND j < nb THEN abs((i + 1)::double / na - (j + 1)::double / nb)
              WHEN i < na THEN abs((i + 1)::double / na - 1) ELSE abs(1 - (j + 1)::double / nb) END) AS ks FROM st GROUP BY service)
"""


def oracle_sql() -> dict[str, str]:
    from .analysis_oracle import analysis_oracle
    from .model_oracle import model_oracle

    return trace_query_sql() | analysis_oracle() | model_oracle()


def trace_query_sql() -> dict[str, str]:
    head = _HEAD.format(n=4)
    tail = """cl AS (SELECT trace_id, max(status) = '2' AS error_trace, max(CASE WHEN parent_span_id IS NULL THEN dur_us END) AS root_dur FROM s GROUP BY trace_id),
        p95 AS (SELECT root_dur AS p FROM (SELECT root_dur, row_number() OVER (ORDER BY root_dur) - 1 AS i, count(*) OVER () AS n FROM cl) WHERE i = floor(n * 0.95::double)),
        cc AS (SELECT trace_id, root_dur, error_trace, error_trace OR root_dur > p AS interesting FROM cl, p95)"""
    interesting = _q("SELECT trace_id, span_id FROM s JOIN cc USING (trace_id) WHERE interesting", tail)
    rate4 = _base_head("count(*)", scale=4.0)
    both = f"{_base_head('count(*)', scale=4.0, name='_r')}, {_base_head('count(*)', where=chr(39) + '2' + chr(39) + ' = status', name='_e')}"
    two = f"{_base_head('count(*)', scale=4.0, name='_m')}, {_base_head('count(*)', n=2, scale=2.0, name='_t')}"
    cats = "cats AS (SELECT 'rate' AS category, fidelity, weight FROM report_r UNION ALL SELECT 'error', fidelity, weight FROM report_e)"
    ols = lambda y: (
        f"round((s_{y} - b_{y} * sx) / n, 6) AS {y}_beta0, round(b_{y}, 6) AS {y}_beta1"
    )
    slope = lambda y: f"CASE WHEN n < 5 OR abs(n * sxx - sx * sx) < 1e-9 THEN 0 ELSE (n * sx_{y} - sx * s_{y}) / (n * sxx - sx * sx) END AS b_{y}"
    comp = "comp AS (SELECT trace_id, root, count(*) AS span_count FROM tree GROUP BY ALL)"
    eta = """
    lg AS (SELECT service AS f, dur_us AS y, 'operation' AS attribute, operation AS v FROM s UNION ALL SELECT service, dur_us, 'kind', kind FROM s UNION ALL SELECT service, dur_us, 'k', k FROM s),
    ok AS (SELECT *, count(*) OVER (PARTITION BY f, attribute, v) AS g FROM lg QUALIFY g >= 5),
    rk AS (SELECT *, rank() OVER (PARTITION BY f, attribute ORDER BY y) + (count(*) OVER (PARTITION BY f, attribute, y) - 1) / 2.0::double AS rk FROM ok),
    sm AS (SELECT f, attribute, v, count(*) AS c, sum(rk) AS r FROM rk GROUP BY ALL),
    tt AS (SELECT f, attribute, sum(t::double * t * t - t) AS ties, sum(t)::double AS n FROM (SELECT f, attribute, y, count(*) AS t FROM ok GROUP BY ALL) GROUP BY ALL),
    hh AS (SELECT f, attribute, n, ties, count(*) AS groups, 12.0::double / (n * (n + 1)) * sum(r * r / c) - 3 * (n + 1) AS h FROM sm JOIN tt USING (f, attribute) GROUP BY f, attribute, n, ties HAVING count(*) >= 2),
    ee AS (SELECT attribute, n, CASE WHEN 1 - ties / (n * n * n - n) > 0 THEN greatest(0, h / (1 - ties / (n * n * n - n)) / (n - 1)) ELSE 0 END AS eta FROM hh)"""
    offsets = """
    om AS (SELECT bucket, p_feature, feature, np AS px, (start_us - p_start)::double AS gap, p_dur::double AS d, 'ratio' AS model, greatest(0, least(1, (start_us - p_start)::double / p_dur)) AS y FROM x WHERE p_dur > 0
           UNION ALL SELECT bucket, p_feature, feature, np, (start_us - p_start)::double, p_dur::double, 'log', ln(1 + greatest(0, (start_us - p_start)::double)) FROM x WHERE p_dur > 0),
    fs AS (SELECT bucket, p_feature, feature, model, count(*) AS n, sum(px) AS sx, sum(y) AS sy, sum(px * px) AS sxx, sum(px * y) AS sxy FROM om GROUP BY ALL),
    fb AS (SELECT *, CASE WHEN n < 5 OR abs(n * sxx - sx * sx) < 1e-9 THEN 0 ELSE (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS b1 FROM fs),
    pr AS (SELECT om.*, n, (sy - b1 * sx) / n + b1 * px AS yh FROM om JOIN fb USING (bucket, p_feature, feature, model)),
    er AS (SELECT bucket, p_feature, feature, model, CASE WHEN n <= 20 THEN 0 ELSE abs(CASE WHEN model = 'ratio' THEN greatest(0, least(1, yh)) * d ELSE exp(greatest(0, yh)) - 1 END - gap) / greatest(abs(gap), 1) END AS e FROM pr),
    pq AS (SELECT bucket, p_feature, feature, model, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.9) AS p90 FROM er GROUP BY ALL),
    pa AS (SELECT p_feature, feature, model, avg(p50) AS p50, avg(p90) AS p90 FROM pq GROUP BY ALL)"""
    cols = """cv AS (SELECT 'kind' AS name, kind AS v FROM s UNION ALL SELECT 'operation', operation FROM s UNION ALL SELECT 'service', service FROM s
        UNION ALL SELECT 'status', status FROM s UNION ALL SELECT 'k', k FROM s),
        cst AS (SELECT name, count(*) AS spans, count(DISTINCT v) AS distinct_values, round(count(*) / (SELECT count(*) FROM s)::double, 6) AS coverage FROM cv WHERE v <> '' GROUP BY name)"""
    pct = lambda c: f"quantile_cont({c}, [{', '.join(str(i / 20) for i in range(21))}])"
    return {
        "duration_percentiles": _q("SELECT group_key, bucket, count(*) AS n, round(quantile_cont(dur_us, 0.5), 6) AS p50, round(quantile_cont(dur_us, 0.9), 6) AS p90, round(quantile_cont(dur_us, 0.99), 6) AS p99 FROM kx GROUP BY ALL", _keys()),
        "spans_flat": _q("SELECT trace_id, span_id, parent_span_id, service, operation, kind, status, start_us, dur_us, has_parent, bucket, error_trace, k FROM s"),
        "trace_summary": _q("SELECT trace_id, bucket, count(*) AS spans, min(start_us) AS start_us, max(error_trace) AS error_trace FROM s GROUP BY ALL"),
        "feature_vocab": _q("SELECT bucket, feature, dense_rank() OVER (PARTITION BY bucket ORDER BY feature) - 1 AS node_idx FROM (SELECT DISTINCT bucket, feature FROM s)"),
        "group_keys": _q("SELECT group_key, count(*) AS n FROM kx GROUP BY ALL", _keys()),
        "rate_over_time": _q("SELECT group_key, bucket, count(*) AS n FROM kx GROUP BY ALL", _keys()),
        "rate_totals": _q("SELECT group_key, count(*) AS n FROM kx GROUP BY ALL", _keys()),
        "error_over_time": _q("SELECT group_key, bucket, count(*) AS n FROM kx GROUP BY ALL", "er AS (SELECT * FROM s WHERE status = '2')", _keys("er")),
        "service_graph_edges": _tree("SELECT bucket, p_node AS parent, node AS child, count(*) AS weight FROM x GROUP BY ALL"),
        "service_graph_nodes": _q("SELECT DISTINCT bucket, node FROM s"),
        "span_count": _tree("SELECT * FROM comp", _DEPTH, comp, recursive=True),
        "span_count_orders": "WITH c AS (SELECT o_orderkey, count(l_orderkey) + 1 AS span_count FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) SELECT span_count, count(*) AS n FROM c GROUP BY ALL",
        "span_count_conversations": """WITH g AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations),
            c AS (SELECT conv_id, run, count(*) AS span_count FROM g GROUP BY ALL) SELECT span_count, count(*) AS n FROM c GROUP BY ALL""",
        "span_depth": _tree("SELECT span_id, root, depth FROM tree", _DEPTH, recursive=True),
        "ancestors": _q("SELECT span_id, ancestor, distance FROM up", _UP, recursive=True),
        "flat_spans": _tree("""SELECT a.trace_id, a.span_id, a.parent_span_id, a.service, a.operation, a.kind, a.status, a.start_us, a.dur_us, t.depth,
            coalesce(p.service, '') AS parent_service, coalesce(p.operation, '') AS parent_operation, a.siblings, a.bucket, a.start_us - a.trace_start AS start_offset_us
            FROM a JOIN tree t USING (trace_id, span_id) LEFT JOIN s p ON p.trace_id = a.trace_id AND p.span_id = a.parent_span_id""", _DEPTH, recursive=True),
        "child_position": _tree("SELECT span_id, position, siblings, round(CASE WHEN siblings > 1 THEN position::double / (siblings - 1) ELSE 0 END, 6) AS normal_position, child_count FROM a"),
        "error_traces": _q("SELECT DISTINCT trace_id FROM s WHERE error_trace"),
        "orphan_stats": _q("SELECT 100.0::double * sum((parent_span_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.trace_id = s.trace_id AND b.span_id = s.parent_span_id))::int) / count(*) AS orphan_percent, 100.0::double AS complete_percent FROM s"),
        "column_stats": _q("SELECT * FROM cst", cols),
        "attribute_discovery": _q("SELECT * FROM cst WHERE coverage >= 0.5 AND name = 'k'", cols),
        "dataset_basics": _q("SELECT count(*) AS spans, count(DISTINCT trace_id) AS traces, count(DISTINCT service) AS services, min(start_us) AS first_us, max(start_us + dur_us) - min(start_us) AS window_us FROM s"),
        "child_sets": _tree("""SELECT feature, sum(c)::bigint AS parents, min(fewest) AS fewest, max(most) AS most, CASE WHEN max(most) = 1 THEN 'single' ELSE 'variable' END AS relay,
            round(max(oc)::double / sum(c), 6) AS top_set_share, round(max(c)::double / sum(c), 6) AS top_multiset_share FROM oo GROUP BY feature""",
            "kd AS (SELECT trace_id, parent_span_id, p_feature AS feature, list_sort(list(feature)) AS l FROM x GROUP BY ALL)",
            "mm AS (SELECT feature, l, list_sort(list_distinct(l)) AS o, count(*) AS c, min(len(l)) AS fewest, max(len(l)) AS most FROM kd GROUP BY ALL)",
            "oo AS (SELECT *, sum(c) OVER (PARTITION BY feature, o) AS oc FROM mm)"),
        "templates": _tree("SELECT template, size, count(*) AS n FROM tp GROUP BY ALL", _DEPTH,
            "tp AS (SELECT t.root, md5(string_agg(t.depth || '|' || replace(a.feature, ';', ',') || '|' || a.child_count, ';' ORDER BY t.depth, t.path)) AS template, count(*) AS size FROM tree t JOIN a USING (trace_id, span_id) GROUP BY t.trace_id, t.root)", recursive=True),
        "unique_edges": _tree("SELECT p_feature AS parent_feature, feature, position, count(*) AS n FROM x GROUP BY ALL"),
        "paths": _q("SELECT c.span_id, g.feature || '>' || p.feature || '>' || c.feature AS path FROM s c JOIN s p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id JOIN s g ON g.trace_id = p.trace_id AND g.span_id = p.parent_span_id"),
        "start_table": _tree("SELECT bucket, trace_type, feature, child_count, count(*) AS n FROM a WHERE NOT has_parent GROUP BY ALL"),
        "topology_edges": _tree("SELECT *, round(n::double / sum(n) OVER (PARTITION BY bucket, trace_type, parent, parent_count, position), 6) AS probability FROM (SELECT bucket, trace_type, p_feature AS parent, siblings AS parent_count, position, feature, child_count, count(*) AS n FROM x GROUP BY ALL)"),
        "duration_bounds": _q("SELECT bucket, feature, min(dur_us) AS lo, max(dur_us) AS hi FROM s WHERE has_parent AND dur_us > 0 GROUP BY ALL"),
        "gap_bounds": _tree("SELECT bucket, feature, min(start_us - p_start) AS lo, max(start_us - p_start) AS hi FROM x WHERE start_us >= p_start GROUP BY ALL"),
        "root_duration_stats": _tree("SELECT bucket, feature, child_count, count(*) AS n, min(dur_us) AS lo, max(dur_us) AS hi, round(avg(ln(dur_us + 1)), 5) AS mean, round(greatest(var_pop(ln(dur_us + 1)), 1e-6), 5) AS variance FROM a WHERE NOT has_parent GROUP BY ALL"),
        "pair_ols": _tree(f"SELECT bucket, parent, feature, n, {ols('gap')}, {ols('dur')} FROM sl", _SAMPLES,
            "su AS (SELECT bucket, parent, feature, count(*) AS n, sum(px) AS sx, sum(px * px) AS sxx, sum(gap) AS s_gap, sum(px * gap) AS sx_gap, sum(dur) AS s_dur, sum(px * dur) AS sx_dur FROM ps GROUP BY ALL)",
            f"sl AS (SELECT *, {slope('gap')}, {slope('dur')} FROM su)"),
        "pair_percentiles": _tree("SELECT bucket, parent, feature, n, unnest(range(21))::int AS i, round(unnest(gp), 6) AS gap, round(unnest(dp), 6) AS dur FROM qq", _SAMPLES,
            f"qq AS (SELECT bucket, parent, feature, count(*) AS n, {pct('gap')} AS gp, {pct('dur')} AS dp FROM ps GROUP BY ALL)"),
        "pair_memorised": _tree("SELECT bucket, parent, feature, n, round(gap, 6) AS gap, round(dur, 6) AS dur FROM (SELECT *, count(*) OVER (PARTITION BY bucket, parent, feature) AS n FROM ps) WHERE n <= 20", _SAMPLES),
        "attr_categorical": _tree("SELECT *, round(n::double / sum(n) OVER (PARTITION BY bucket, parent, feature), 6) AS probability FROM (SELECT bucket, parent, feature, k AS value, count(*) AS n FROM ps GROUP BY ALL)", _SAMPLES),
        "bucket_meta": _q("SELECT bucket, min(trace_start) AS first_us, max(trace_start) AS last_us, count(DISTINCT trace_id) AS traces, max(z) AS max_tree FROM (SELECT *, count(*) OVER (PARTITION BY trace_id) AS z FROM s) GROUP BY bucket"),
        "head_sample": _q(f"SELECT trace_id, span_id FROM s WHERE {head}"),
        "tail_classes": _q("SELECT * FROM cc", tail),
        "tail_sample": interesting,
        "hindsight_sample": interesting,
        "service_stats": _q("SELECT service, count(*) AS total, sum((status = '2')::int)::bigint AS errors, round(avg(dur_us), 4) AS mean_us FROM s GROUP BY ALL"),
        "ks_by_service": _q("SELECT DISTINCT f.service, round(coalesce(ks, 0), 9) AS ks FROM f LEFT JOIN ks USING (service) WHERE side = 0", _KS),
        "trace_rca": _q("SELECT service, round(er, 6) AS error_rate, round(ks, 6) AS ks, round(0.5 * er + 0.5 * ks, 6) AS score, row_number() OVER (ORDER BY round(0.5 * er + 0.5 * ks, 12) DESC, service) AS rank FROM rt JOIN kz USING (service)", _KS,
            f"rt AS (SELECT service, sum((status = '2')::int)::double / count(*) AS er FROM s WHERE start_us >= {INJECT} GROUP BY ALL)",
            "kz AS (SELECT DISTINCT f.service, coalesce(ks, 0) AS ks FROM f LEFT JOIN ks USING (service) WHERE side = 0)"),
        "call_graph": _tree("SELECT p_service AS caller, service AS callee, count(*) AS weight FROM x WHERE service <> p_service GROUP BY ALL"),
        "cusum": _q("SELECT service, signal, time, round(up, 5) AS up, round(down, 5) AS down, round(size, 5) AS size, alarm FROM cu", _SIGNALS, recursive=True),
        "anomaly_localise": _q("SELECT service, round(max(size), 5) AS size, min(time) AS first_alarm, row_number() OVER (ORDER BY round(max(size), 9) DESC, service) AS rank FROM cu WHERE alarm GROUP BY service", _SIGNALS, recursive=True),
        "detection_report": _q(f"""SELECT fa AS first_alarm, detected, delay, false_alarms, round(false_alarm_rate, 6) AS false_alarm_rate, ac1, ac2, ac3, ac4, ac5 FROM ({detected(INJECT // DAY)})""",
            _SIGNALS, _LOCALISED, recursive=True),
        "attribute_eta2": _q("SELECT attribute, count(*) AS features, sum(n)::bigint AS n, round(sum(eta * n) / sum(n), 6) AS eta2 FROM ee GROUP BY attribute", eta),
        "offset_models": _tree("SELECT model, count(*) AS pairs, round(avg(p50), 5) AS p50, round(avg(p90), 5) AS p90 FROM pa GROUP BY model", offsets),
        "edge_cover": _tree("SELECT parent, child, count(*) AS weight FROM (SELECT DISTINCT span_id, parent, child FROM (SELECT span_id, p_node AS parent, node AS child FROM x UNION ALL SELECT up.span_id, x.p_node, x.node FROM up JOIN x ON x.trace_id = up.trace_id AND x.span_id = up.ancestor)) GROUP BY ALL", _UP, recursive=True),
        "report_rate": _q("SELECT group_key, round(mape, 6) AS mape, round(fidelity, 6) AS fidelity, weight FROM report", rate4),
        "report_error": _q("SELECT group_key, round(mape, 6) AS mape, round(fidelity, 6) AS fidelity, weight FROM report", _base_head("count(*)", where="status = '2'")),
        "report_duration": _durations(),
        "report_graph": _graph(False),
        "report_graph_binary": _graph(True),
        "report_span_count": _tree("SELECT round(coalesce(sum(g), 0), 6) AS distance FROM gg", _DEPTH, comp,
            f"ww AS (SELECT span_count AS v, count(*)::double AS ca, sum(({head})::int)::double AS cb FROM comp GROUP BY ALL)",
            "gg AS (SELECT abs(sum(ca) OVER o / sum(ca) OVER () - sum(cb) OVER o / sum(cb) OVER ()) * (lead(v) OVER o - v) AS g FROM ww WINDOW o AS (ORDER BY v))", recursive=True),
        "cosine_fidelity": _q("SELECT group_key, count(*) AS times, round(CASE WHEN count(*) = 1 THEN (max(v) = max(o))::int::double ELSE sum(v * o) / (sqrt(sum(v * v)) * sqrt(sum(o * o))) END, 6) AS cosine FROM vb JOIN vo USING (group_key, bucket) GROUP BY group_key", _base_head("count(*)")),
        "scorecard": _q("SELECT 'head_4' AS approach, category, count(*) AS n, round(avg(fidelity), 5) AS mean, round(min(fidelity), 5) AS least, round(max(fidelity), 5) AS most, 0.0::double AS deviation FROM cats GROUP BY category", both, cats),
        "mean_fidelity": _q("SELECT 'head_4' AS approach, round((SELECT avg(m) FROM (SELECT avg(fidelity) AS m FROM cats GROUP BY category)), 5) AS mean, round(sum(fidelity * weight) / sum(weight), 5) AS weighted FROM cats", both, cats),
        "level_means": _q("SELECT CASE WHEN group_key = 'all' THEN 0 ELSE len(string_split(group_key, '!@#')) END::int AS level, count(*) AS groups, round(sum(fidelity * weight) / sum(weight), 5) AS weighted, round(avg(fidelity), 5) AS mean FROM report GROUP BY 1", rate4),
        "cost": _q(f"""SELECT approach, bytes, 3600.0::double AS cpu_s, 0.0::double AS gpu_s, round(bytes::double / 1073741824 * 0.1::double + 0.16::double, 9) AS dollars FROM (
            SELECT 'all' AS approach, sum(length(trace_id) + length(span_id) + 16)::bigint AS bytes FROM s UNION ALL SELECT 'head_4', sum(length(trace_id) + length(span_id) + 16)::bigint FROM s WHERE {head})"""),
        "failure_rows": _q("""SELECT group_key, round(m.mape, 6) AS mape, round(m.fidelity, 6) AS fidelity, m.weight, round(t.fidelity, 6) AS their_fidelity, round(m.fidelity - t.fidelity, 6) AS delta,
            row_number() OVER (ORDER BY round(m.fidelity - t.fidelity, 9), group_key) AS place FROM report_m m JOIN report_t t USING (group_key)""", two),
        "sibling_skew": _q("SELECT prefix, count(*) AS cardinality, sum(n)::bigint AS occurrences, round(CASE WHEN count(*) > 1 THEN 1 + sum(n / tot * ln(n / tot)) / ln(count(*)) ELSE 1 END, 6) AS skew FROM pp GROUP BY prefix", _keys(),
            "tt AS (SELECT group_key, count(*)::double AS n FROM kx WHERE group_key <> 'all' GROUP BY ALL)",
            "pp AS (SELECT regexp_replace(group_key, ':[^:]*$', '') AS prefix, n, sum(n) OVER (PARTITION BY regexp_replace(group_key, ':[^:]*$', '')) AS tot FROM tt)"),
        "envelope_repair": _q("SELECT s.span_id, least(s.start_us, coalesce(lo, s.start_us)) AS start_us, greatest(s.start_us + s.dur_us, coalesce(hi, s.start_us + s.dur_us)) - least(s.start_us, coalesce(lo, s.start_us)) AS dur_us FROM s LEFT JOIN dn ON dn.trace_id = s.trace_id AND dn.ancestor = s.span_id", _UP,
            "dn AS (SELECT up.trace_id, ancestor, min(start_us) AS lo, max(start_us + dur_us) AS hi FROM up JOIN s ON s.trace_id = up.trace_id AND s.span_id = up.span_id GROUP BY ALL)", recursive=True),
        "remap": _q(f"SELECT span_id, start_us - lo + ('0x' || substr(md5('remap:42:' || trace_id), 1, 8))::bigint % ({DAY} - len + 1) AS start_us, dur_us FROM m WHERE len <= {DAY}",
            "m AS (SELECT *, min(start_us) OVER (PARTITION BY trace_id) AS lo, max(start_us + dur_us) OVER (PARTITION BY trace_id) - min(start_us) OVER (PARTITION BY trace_id) AS len FROM s)"),
        "max_traces": _q("SELECT span_id FROM s WHERE trace_id IN (SELECT trace_id FROM (SELECT DISTINCT trace_id FROM s) ORDER BY md5(trace_id || ':42'), trace_id LIMIT 100)"),
        "chunks": _q("SELECT span_id, (('0x' || substr(md5(trace_id), 1, 8))::bigint % subs)::int AS chunk FROM s JOIN (SELECT bucket, ceil(count(*) / 100.0::double)::bigint AS subs FROM s GROUP BY bucket) USING (bucket)"),
    }
