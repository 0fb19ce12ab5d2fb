"""DuckDB SQL for the queries of ``analysis_queries``."""

from __future__ import annotations

from .oracle import _DEPTH, _ENTRIES, _ERROR, _HEAD, _KEYS, _KS, _LOCALISED, _SIGNALS, _UP, DAY, INJECT, _base_head, _keys, _q, _tree, detected

_TAIL = """cl AS (SELECT trace_id, max(status) = '2' AS error_trace, max(CASE WHEN parent_span_id IS NULL THEN dur_us END) AS root_dur FROM s GROUP BY trace_id),
        p95 AS (SELECT root_dur AS p FROM (SELECT root_dur, row_number() OVER (ORDER BY root_dur) - 1 AS i, count(*) OVER () AS n FROM cl) WHERE i = floor(n * 0.95::double)),
        cc AS (SELECT trace_id, error_trace OR root_dur > p AS interesting FROM cl, p95)"""
_SIZE = """length(trace_id) + length(span_id) + coalesce(length(parent_span_id), 0) + length(service) + length(operation) + length(kind)
        + length(status) + length(k) + 16"""
_CONTEXT = f"""
gs AS (SELECT s.span_id, s.trace_id, {_ENTRIES} AS en FROM s),
ks_ AS (SELECT span_id, unnest(['all'] || en || [en[1] || '!@#' || en[2], en[1] || '!@#' || en[3], en[1] || '!@#' || en[4],
        en[2] || '!@#' || en[3], en[2] || '!@#' || en[4], en[3] || '!@#' || en[4]]) AS group_key FROM gs),
pe AS (SELECT DISTINCT span_id, e FROM (SELECT span_id, p_feature || '>' || feature AS e FROM x
       UNION ALL SELECT up.span_id, x.p_feature || '>' || x.feature FROM up JOIN x ON x.trace_id = up.trace_id AND x.span_id = up.ancestor)),
wg AS (SELECT e, count(*) AS w FROM pe GROUP BY e),
wq AS (SELECT group_key, e, count(*) AS w FROM ks_ JOIN pe USING (span_id) GROUP BY ALL),
se AS (SELECT group_key, 1.0::double - sum(wq.w) / sum(wg.w) AS r FROM wq JOIN wg USING (e) GROUP BY group_key),
ad AS (SELECT group_key, count(*) AS n, avg(depth) AS d FROM ks_ JOIN tree USING (span_id) GROUP BY group_key),
cx AS (SELECT group_key, n, round(d, 6) AS avg_depth, round(coalesce(r, 0), 6) AS shared_edge_rate FROM ad LEFT JOIN se USING (group_key))
"""
_SKEW = """
tt AS (SELECT group_key, count(*)::double AS n FROM kx WHERE group_key <> 'all' GROUP BY ALL),
pp AS (SELECT regexp_replace(group_key, ':[^:]*$', '') AS prefix, n, sum(n) OVER (PARTITION BY regexp_replace(group_key, ':[^:]*$', '')) AS tot FROM tt),
sk AS (SELECT prefix, count(*) AS cardinality, sum(n)::bigint AS occurrences, round(CASE WHEN count(*) > 1 THEN 1 + sum(n / tot * ln(n / tot)) / ln(count(*)) ELSE 1 END, 6) AS skew FROM pp GROUP BY prefix)
"""


def _sizes() -> str:
    head = _HEAD.format(n=4)
    interesting = "trace_id IN (SELECT trace_id FROM cc WHERE interesting)"
    parts = []
    for name, stored, handled in (("all", "TRUE", "TRUE"), ("head_4", head, head), ("tail", interesting, "TRUE"), ("hindsight", interesting, interesting)):
        parts.append(f"""SELECT '{name}' AS approach, bucket, count(*) FILTER (WHERE {stored}) AS stored_spans,
            coalesce(sum({_SIZE}) FILTER (WHERE {stored}), 0)::bigint AS stored_bytes, sum({_SIZE})::bigint AS handled_bytes FROM s WHERE {handled} GROUP BY bucket""")
    return f"{_TAIL}, sz AS ({' UNION ALL '.join(parts)})"


_COSTS = """co AS (SELECT approach, sum(stored_spans)::bigint AS stored_spans, sum(stored_bytes)::bigint AS stored_bytes, sum(handled_bytes)::bigint AS handled_bytes FROM sz GROUP BY approach),
cd AS (SELECT *, handled_bytes / 1073741824.0::double * 60.0::double AS cpu_s, stored_bytes / 1073741824.0::double * 0.1::double + handled_bytes / 1073741824.0::double * 60.0::double / 3600.0::double * 0.16::double AS dollars FROM co)"""


def _report(name: str, where: str, pick: str, scale: float) -> str:
    """Counts of the base and of what an approach keeps, and their report, as CTEs."""
    keys = lambda tag, cond: _KEYS.format(entries=_ENTRIES, source=f"{tag}{name}").replace("g AS", f"g_{tag}{name} AS").replace("kx AS", f"kx_{tag}{name} AS").replace("FROM g)", f"FROM g_{tag}{name})")
    return f"""
    zb{name} AS (SELECT * FROM s WHERE {where}), zo{name} AS (SELECT * FROM s WHERE {where} AND {pick}),
    {keys('zb', where)}, {keys('zo', where)},
    yb{name} AS (SELECT group_key, bucket, count(*) AS v FROM kx_zb{name} GROUP BY ALL),
    yo{name} AS (SELECT group_key, bucket, count(*) * {scale}::double AS o FROM kx_zo{name} GROUP BY ALL),
    ym{name} AS (SELECT yb{name}.group_key, avg(CASE WHEN o IS NOT NULL THEN {_ERROR.format(a='v::double', b='o::double')} END) AS m, sum(v)::bigint AS weight
        FROM yb{name} LEFT JOIN yo{name} USING (group_key, bucket) GROUP BY yb{name}.group_key),
    yr{name} AS (SELECT group_key, CASE WHEN m IS NULL THEN 0 ELSE greatest(0, 100 - m) END AS fidelity, weight FROM ym{name})"""


def _summary(rows: str, metrics: tuple[str, ...]) -> str:
    long = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::double AS v FROM {rows}" for m in metrics)
    return f"""SELECT metric, count(*) AS n, round(avg(v), 5) AS mean, round(coalesce(stddev_samp(v), 0), 5) AS deviation, round(stddev_pop(v), 5) AS population_deviation
        FROM ({long}) WHERE v IS NOT NULL GROUP BY metric"""


_RCA = (
    _KS,
    f"rt AS (SELECT service, sum((status = '2')::int)::double / count(*) AS er FROM s WHERE start_us >= {INJECT} GROUP BY ALL)",
    "kz AS (SELECT DISTINCT f.service, coalesce(ks, 0) AS ks FROM f LEFT JOIN ks USING (service) WHERE side = 0)",
    "rr AS (SELECT service, row_number() OVER (ORDER BY round(0.5 * er + 0.5 * ks, 12) DESC, service) AS rank FROM rt JOIN kz USING (service))",
    "rh AS (SELECT a.service || '_cpu' AS scenario, a.service AS answer, "
    + ", ".join(f"coalesce(rank <= {i}, false)::int AS ac{i}" for i in range(1, 6))
    + ", round((ac1 + ac2 + ac3 + ac4 + ac5) * 100.0::double / 5, 6) AS hit_fidelity FROM (SELECT DISTINCT service FROM s) a LEFT JOIN rr USING (service))",
)


def _detections() -> str:
    days = (INJECT // DAY - 5, INJECT // DAY, INJECT // DAY + 5)
    one = [f"SELECT detected::int AS detected, delay, false_alarms, false_alarm_rate, ac1, ac5 FROM ({detected(day)})" for day in days]
    return f"{_SIGNALS}, {_LOCALISED}, de AS ({' UNION ALL '.join(one)})"


def _graphs(scale: float) -> tuple[str, ...]:
    head = _HEAD.format(n=4)
    return (
        "ea AS (SELECT bucket, p_node, node, count(*)::double AS wa FROM x GROUP BY ALL)",
        f"eb AS (SELECT bucket, p_node, node, count(*) * {scale}::double AS wb FROM x WHERE {head} GROUP BY ALL)",
        "na AS (SELECT DISTINCT bucket, node FROM s)",
        f"nb AS (SELECT DISTINCT bucket, node FROM s WHERE {head})",
        "ge AS (SELECT bucket, sum(abs(coalesce(wa, 0) - coalesce(wb, 0))) AS e, sum(coalesce(wa, 0)) AS w, sum(coalesce(wa, 0) + coalesce(wb, 0)) AS w2 FROM ea FULL JOIN eb USING (bucket, p_node, node) GROUP BY bucket)",
        "gn AS (SELECT bucket, sum((na.node IS NULL OR nb.node IS NULL)::int) AS n, count(na.node) AS m, count(nb.node) AS has FROM na FULL JOIN nb USING (bucket, node) GROUP BY bucket)",
    )


def analysis_oracle() -> dict[str, str]:
    two = f"{_base_head('count(*)', scale=4.0, name='_m')}, {_base_head('count(*)', n=2, scale=2.0, name='_t')}"
    failed = "fr AS (SELECT group_key, m.fidelity, m.weight, t.fidelity AS theirs, m.fidelity - t.fidelity AS delta, row_number() OVER (ORDER BY round(m.fidelity - t.fidelity, 9), group_key) AS place FROM report_m m JOIN report_t t USING (group_key))"
    scanned = """SELECT lpad(lower(trace_id), 32, '0') AS trace_id, lpad(lower(span_id), 16, '0') AS span_id, lpad(lower(parent_span_id), 16, '0') AS parent_span_id,
        service, operation, {kind} AS kind, status, start_us, dur_us, k FROM s"""
    head = _HEAD.format(n=4)
    mixed = f"""{_TAIL}, {_report('h', 'TRUE', head, 4.0)}, {_report('i', "status = '2'", head, 1.0)},
        {_report('t', 'TRUE', 'trace_id IN (SELECT trace_id FROM cc WHERE interesting)', 1.0)}, {_report('u', "status = '2'", 'trace_id IN (SELECT trace_id FROM cc WHERE interesting)', 1.0)},
        ct AS (SELECT 'head_4' AS approach, 'rate' AS c, fidelity, weight FROM yrh UNION ALL SELECT 'head_4', 'error', fidelity, weight FROM yri
               UNION ALL SELECT 'tail', 'rate', fidelity, weight FROM yrt UNION ALL SELECT 'tail', 'error', fidelity, weight FROM yru),
        cm AS (SELECT approach, avg(m) AS mean, sum(fw) / sum(w) AS weighted FROM (SELECT approach, c, avg(fidelity) AS m, sum(fidelity * weight) AS fw, sum(weight) AS w FROM ct GROUP BY ALL) GROUP BY approach)"""
    return {
        "dashboard": _q("""SELECT bucket, service, count(*) AS n, round(avg((status = '2')::int), 6) AS error_rate, round(quantile_cont(dur_us, 0.5), 6) AS p50,
            round(quantile_cont(dur_us, 0.95), 6) AS p95, round(quantile_cont(dur_us, 0.99), 6) AS p99 FROM s GROUP BY ALL"""),
        "names_over_time": _q("SELECT bucket, operation, count(*) AS n FROM s GROUP BY ALL"),
        "matching_spans": _q("SELECT span_id FROM s WHERE kind = 'CLIENT' AND operation = 'k1'"),
        "query_context": _tree("SELECT * FROM cx", _DEPTH, _UP, _CONTEXT, recursive=True),
        "failure_analysis": _tree(
            """SELECT group_key, CASE WHEN group_key = 'all' THEN 0 ELSE len(string_split(group_key, '!@#')) END::int AS level,
            CASE WHEN group_key = 'all' THEN '-' ELSE array_to_string(list_transform(string_split(group_key, '!@#'), lambda p: CASE WHEN starts_with(p, 'status:') THEN 'M' ELSE 'F' END), ';') END AS filter_type,
            CASE WHEN group_key = 'all' THEN 0 ELSE len(list_filter(string_split(group_key, '!@#'), lambda p: starts_with(p, 'status:'))) END::bigint AS meta_filters,
            fr.weight, cardinality, occurrences, skew, coalesce(avg_depth, -1) AS avg_depth, coalesce(shared_edge_rate, -1) AS shared_edge_rate,
            round(fidelity, 6) AS fidelity, round(theirs, 6) AS their_fidelity, round(delta, 6) AS delta, place
            FROM fr LEFT JOIN sk ON group_key <> 'all' AND regexp_replace(group_key, ':[^:]*$', '') = sk.prefix LEFT JOIN cx USING (group_key)""",
            _DEPTH, _UP, _CONTEXT, two, failed, _keys(), _SKEW, recursive=True,
        ),
        "failure_histogram": _q("""SELECT scope, least(19, greatest(0, floor((delta + 100) / 200 * 20)))::bigint AS bin, count(*) AS n
            FROM (SELECT 'all' AS scope, delta FROM fr UNION ALL SELECT 'worst', delta FROM fr WHERE place <= 20) GROUP BY ALL""", two, failed),
        "sampler_sizes": _q("SELECT * FROM sz", _sizes()),
        "sampler_costs": _q("SELECT approach, stored_spans, stored_bytes, handled_bytes, round(cpu_s, 9) AS cpu_s, round(dollars, 9) AS dollars FROM cd", _sizes(), _COSTS),
        "fidelity_cost": _q("SELECT approach, round(mean, 5) AS mean, round(weighted, 5) AS weighted, round(dollars, 9) AS dollars FROM cm JOIN cd USING (approach)",
            mixed, _sizes().replace(_TAIL + ", ", ""), _COSTS),
        "rca_hits": _q("SELECT * FROM rh", *_RCA),
        "rca_points": _q(_summary("rh", ("ac1", "ac3", "ac5", "hit_fidelity")), *_RCA),
        "anomaly_summary": _q(_summary("de", ("detected", "delay", "false_alarms", "false_alarm_rate", "ac1", "ac5")), _detections(), recursive=True),
        "graph_likeness": _tree("SELECT bucket, round((n + coalesce(e, 0))::double, 6) AS distance, round(greatest(0, 100 - 100 * (n + coalesce(e, 0))::double / (m + coalesce(w2, 0))), 6) AS fidelity FROM gn LEFT JOIN ge USING (bucket) WHERE m > 0", *_graphs(1.0)),
        "graph_points": _tree("SELECT count(*) AS times, round(quantile_cont(f, 0.5), 5) AS median, round(avg(f), 5) AS mean, round(stddev_pop(f), 5) AS population_deviation FROM gf", *_graphs(4.0),
            "gf AS (SELECT CASE WHEN has = 0 THEN 0 ELSE greatest(0, 100 - 100 * (n + coalesce(e, 0))::double / (m + coalesce(w, 0))) END AS f FROM gn LEFT JOIN ge USING (bucket) WHERE m > 0)"),
        "attribute_draws": _q("""SELECT s.span_id, p.value FROM s LEFT JOIN (SELECT DISTINCT service, operation, true AS known FROM fit) kn USING (service, operation)
            JOIN pr p ON (CASE WHEN known THEN s.service END) IS NOT DISTINCT FROM p.service AND (CASE WHEN known THEN s.operation END) IS NOT DISTINCT FROM p.operation
            AND (('0x' || substr(md5('attribute:k:42:' || s.span_id), 1, 8))::bigint + 0.5::double) / 4294967296 > p.a AND (('0x' || substr(md5('attribute:k:42:' || s.span_id), 1, 8))::bigint + 0.5::double) / 4294967296 <= p.z""",
            f"fit AS (SELECT service, operation, k AS value FROM s WHERE {head})",
            "fn AS (SELECT service, operation, value, count(*) AS n FROM fit GROUP BY ALL UNION ALL SELECT NULL, NULL, value, count(*) FROM fit GROUP BY value)",
            "fz AS (SELECT *, sum(n) OVER (PARTITION BY service, operation ORDER BY value)::double / sum(n) OVER (PARTITION BY service, operation) AS z FROM fn)",
            "pr AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY service, operation ORDER BY value), 0) AS a FROM fz)"),
        "vocabulary_delta": _q("""SELECT bucket, feature, coalesce(m, -1) + row_number() OVER (PARTITION BY bucket ORDER BY feature) AS node_idx FROM nw LEFT JOIN mx USING (bucket)""",
            "old AS (SELECT DISTINCT bucket, feature FROM s WHERE NOT error_trace)",
            "mx AS (SELECT bucket, count(*) - 1 AS m FROM old GROUP BY bucket)",
            "nw AS (SELECT DISTINCT bucket, feature FROM s WHERE (bucket, feature) NOT IN (SELECT bucket, feature FROM old))"),
        "otlp_scan": _q(scanned.format(kind="kind")),
        "jaeger_scan": _q(scanned.format(kind="kind")),
        "csv_scan": _q(scanned.format(kind="''")),
        "run_statistics": _q("""SELECT count(*) AS runs, floor(avg(n))::bigint AS spans, floor(avg(t))::bigint AS traces, round(avg(w), 3) AS window_s, (SELECT count(DISTINCT service) FROM s) AS services
            FROM (SELECT split_part(trace_id, '-', 1)::bigint % 6 AS p, count(*) AS n, count(DISTINCT trace_id) AS t, (max(start_us + dur_us) - min(start_us)) / 1e6::double AS w FROM s GROUP BY p)"""),
    }
