"""DuckDB SQL for the queries over models, attribute keys and posting lists: one pass over all spans, whatever parts the
queries were trained in."""

from __future__ import annotations

from .analysis_oracle import _CONTEXT, _SIZE, _SKEW, _TAIL
from .oracle import _ATTRIBUTE_ENTRIES, _DEPTH, _HEAD, _SAMPLES, _UP, _base_head, _keys, _q, _tree, any_keys


def _model() -> str:
    slope = lambda y: f"CASE WHEN n < 5 OR abs(n * sxx - sx * sx) < 1e-9 THEN 0 ELSE (n * sx_{y} - sx * s_{y}) / (n * sxx - sx * sx) END AS b_{y}"
    row = lambda field, name, n, source, *numbers: (
        f"SELECT '{field}' AS field, bucket, {name} AS name, {n}::bigint AS n, "
        + ", ".join(f"{f'round({numbers[i]}, 6)' if i < len(numbers) else 'NULL'}::double AS {c}" for i, c in enumerate("abcd"))
        + f" FROM {source}"
    )
    parts = [
        row("start", "trace_type || '/' || feature || '/' || child_count", "n", "(SELECT bucket, trace_type, feature, child_count, count(*) AS n FROM a WHERE NOT has_parent GROUP BY ALL)"),
        row("edge", "trace_type || '/' || parent || '/' || parent_count || '/' || position || '/' || feature || '/' || child_count", "n", "ed", "n::double / sum(n) OVER (PARTITION BY bucket, trace_type, parent, parent_count, position)"),
        row("root", "feature || '/' || child_count", "n", "(SELECT bucket, feature, child_count, count(*) AS n, min(dur_us) AS lo, max(dur_us) AS hi, avg(ln(dur_us + 1)) AS m FROM a WHERE NOT has_parent GROUP BY ALL)", "lo", "hi", "round(m, 4)"),
        row("duration", "feature", "NULL", "(SELECT bucket, feature, min(dur_us) AS lo, max(dur_us) AS hi FROM s WHERE has_parent AND dur_us > 0 GROUP BY ALL)", "lo", "hi"),
        row("gap", "feature", "NULL", "(SELECT bucket, feature, min(start_us - p_start) AS lo, max(start_us - p_start) AS hi FROM x WHERE start_us >= p_start GROUP BY ALL)", "lo", "hi"),
        row("pair", "parent || '/' || feature", "n", "sl", "(s_gap - b_gap * sx) / n", "b_gap", "(s_dur - b_dur * sx) / n", "b_dur"),
        row("sample", "parent || '/' || feature", "n", "(SELECT *, count(*) OVER (PARTITION BY bucket, parent, feature) AS n FROM ps) WHERE n <= 20", "gap", "dur"),
        row("meta", "''", "n", "(SELECT bucket, count(DISTINCT trace_id) AS n, min(trace_start) AS lo, max(trace_start) AS hi, max(z) AS z FROM (SELECT *, count(*) OVER (PARTITION BY trace_id) AS z FROM s) GROUP BY bucket)", "lo", "hi", "z"),
        row("k", "parent || '/' || feature || '/' || k", "n", "(SELECT bucket, parent, feature, k, count(*) AS n FROM ps GROUP BY ALL)", "n::double / sum(n) OVER (PARTITION BY bucket, parent, feature)"),
    ]
    return _tree(
        " UNION ALL ".join(parts), _SAMPLES,
        "ed AS (SELECT bucket, trace_type, p_feature AS parent, siblings AS parent_count, position, feature, child_count, count(*) AS n FROM x GROUP BY ALL)",
        "su AS (SELECT bucket, parent, feature, count(*) AS n, sum(px) AS sx, sum(px * px) AS sxx, sum(gap) AS s_gap, sum(px * gap) AS sx_gap, sum(dur) AS s_dur, sum(px * dur) AS sx_dur FROM ps GROUP BY ALL)",
        f"sl AS (SELECT *, {slope('gap')}, {slope('dur')} FROM su)",
    )


def _sections() -> str:
    """Five sections, each a pair of reports, with what explains them."""
    parts, rows = [], []
    for name, kind, percentile, value, where, scaled in (
        ("ra", "rate", "-", "count(*)", "TRUE", True), ("er", "error", "-", "count(*)", "status = '2'", True), ("d5", "duration", "p50", "quantile_cont(dur_us, 0.5)", "TRUE", False),
        ("d9", "duration", "p90", "quantile_cont(dur_us, 0.9)", "TRUE", False), ("dx", "duration", "p99", "quantile_cont(dur_us, 0.99)", "TRUE", False),
    ):
        parts += [_base_head(value, where=where, scale=4.0 if scaled else 1.0, name=f"_{name}m"), _base_head(value, where=where, n=2, scale=2.0 if scaled else 1.0, name=f"_{name}t")]
        rows.append(f"""SELECT '{kind}' AS query_type, '{percentile}' AS percentile, m.group_key, m.weight, m.fidelity, t.fidelity AS theirs, m.fidelity - t.fidelity AS delta,
            row_number() OVER (ORDER BY round(m.fidelity - t.fidelity, 9), m.group_key) AS place FROM report_{name}m m JOIN report_{name}t t ON m.group_key = t.group_key""")
    level = "CASE WHEN group_key = 'all' THEN 0 ELSE len(string_split(group_key, '!@#')) END"
    meta = "CASE WHEN group_key = 'all' THEN 0 ELSE len(list_filter(string_split(group_key, '!@#'), lambda p: starts_with(p, 'status:'))) END"
    return _tree(
        f"""SELECT query_type, percentile, group_key, ({level})::int AS level,
        CASE WHEN group_key = 'all' THEN '-' ELSE array_to_string(list_transform(string_split(group_key, '!@#'), lambda p: CASE WHEN starts_with(p, 'status:') THEN 'M' ELSE 'F' END), ';') END AS filter_type,
        ({meta})::bigint AS meta_filters, weight, cardinality, occurrences, skew, coalesce(avg_depth, -1) AS avg_depth, coalesce(shared_edge_rate, -1) AS shared_edge_rate,
        round(fidelity, 6) AS fidelity, round(theirs, 6) AS their_fidelity, round(delta, 6) AS delta, place,
        round(CASE WHEN group_key = 'all' THEN 0 ELSE ({meta})::double / ({level}) END, 6) AS meta_ratio
        FROM fr LEFT JOIN sk ON group_key <> 'all' AND regexp_replace(group_key, ':[^:]*$', '') = sk.prefix LEFT JOIN cx USING (group_key)""",
        _DEPTH, _UP, _CONTEXT, *parts, f"fr AS ({' UNION ALL '.join(rows)})", _keys(), _SKEW, recursive=True,
    )


_OFFSETS = """
om AS (SELECT bucket // 30 AS b, p_service AS p, service AS c, np AS px, (start_us - p_start)::double AS gap, dur_us::double AS dur, p_dur::double AS d FROM x WHERE p_dur > 0),
ot AS (SELECT *, greatest(0, gap) / d AS rg, greatest(0, dur) / d AS rd, ln(1 + greatest(0, gap)) AS lg, ln(1 + greatest(0, dur)) AS ld, dur > 0 AND gap >= 0 AS ok FROM om),
os AS (SELECT b, p, c, count(*) AS n, sum(px) AS sx, sum(px * px) AS sxx, sum(ok::int) AS valid, min(gap) FILTER (ok) AS g0, max(gap) FILTER (ok) AS g1, min(dur) FILTER (ok) AS d0, max(dur) FILTER (ok) AS d1,
       {sums} FROM ot GROUP BY ALL),
ol AS (SELECT *, n * sxx - sx * sx AS det FROM os),
ob AS (SELECT *, {slopes} FROM ol),
oz AS (SELECT ot.*, valid, g0, g1, d0, d1, {lines} FROM ot JOIN ob USING (b, p, c) WHERE ok),
oc AS (SELECT *, greatest(0, least(1, greatest(g0, least(g1, greatest(0, least(1, y_rg)) * d)) / d)) AS sg, greatest(0, least(1, greatest(d0, least(d1, greatest(0, least(1, y_rd)) * d)) / d)) AS sd FROM oz),
og AS (SELECT b, p, c, valid, gap, dur,
       CASE WHEN valid <= 20 THEN gap ELSE (CASE WHEN sg + sd > 1 THEN sg / (sg + sd) ELSE sg END) * d END AS ratio_gap,
       CASE WHEN valid <= 20 THEN dur ELSE greatest(1, (CASE WHEN sg + sd > 1 THEN sd / (sg + sd) ELSE sd END) * d) END AS ratio_dur,
       CASE WHEN valid <= 20 THEN gap ELSE greatest(0, least(d, greatest(g0, least(g1, exp(greatest(0, least(30, y_lg))) - 1)))) END AS log_gap,
       CASE WHEN valid <= 20 THEN dur ELSE greatest(1, greatest(0, least(d, greatest(d0, least(d1, exp(greatest(0, least(30, y_ld))) - 1))))) END AS log_dur FROM oc),
oq AS (SELECT b, p, c, max(valid) AS valid, {quantiles} FROM og GROUP BY ALL)
""".format(
    sums=", ".join(f"sum({t}) AS s_{t}, sum(px * {t}) AS sx_{t}" for t in ("rg", "rd", "lg", "ld")),
    slopes=", ".join(f"CASE WHEN n < 2 OR abs(det) < 1e-15 THEN 0 ELSE (n * sx_{t} - sx * s_{t}) / det END AS b_{t}" for t in ("rg", "rd", "lg", "ld")),
    lines=", ".join(f"(s_{t} - b_{t} * sx) / n + b_{t} * px AS y_{t}" for t in ("rg", "rd", "lg", "ld")),
    quantiles=", ".join(f"quantile_cont({v}, [0.5, 0.9, 0.99]) AS {v}" for v in ("gap", "dur", "ratio_gap", "ratio_dur", "log_gap", "log_dur")),
)


def _offset_percentiles() -> str:
    names = [(y, i, f"{y}_{q}") for y in ("gap", "dur") for i, q in enumerate(("p50", "p90", "p99"), 1)]
    each = " UNION ALL ".join(
        f"SELECT '{m}' AS model, b, p, c, valid, " + ", ".join(f"CASE WHEN {y}[{i}] > 0 THEN abs({m}_{y}[{i}] - {y}[{i}]) / {y}[{i}] ELSE 0 END AS {n}" for y, i, n in names) + " FROM oq"
        for m in ("ratio", "log")
    )
    return _tree(
        f"SELECT model, count(*) AS pairs, sum(g)::bigint AS groups, sum(k)::bigint AS memorised, {', '.join(f'round(avg({n}), 5) AS {n}' for *_, n in names)} FROM op GROUP BY model", _OFFSETS,
        f"op AS (SELECT model, p, c, count(*) AS g, sum((valid <= 20)::int) AS k, {', '.join(f'avg({n}) AS {n}' for *_, n in names)} FROM ({each}) GROUP BY model, p, c)",
    )


def model_oracle() -> dict[str, str]:
    keys = any_keys(_ATTRIBUTE_ENTRIES)
    errors = any_keys(_ATTRIBUTE_ENTRIES, "er")
    whole = _model()
    return {
        "rate_by_attribute": _q("SELECT group_key, bucket, count(*) AS n FROM kx GROUP BY ALL", keys),
        "error_by_attribute": _q("SELECT group_key, bucket, count(*) AS n FROM kx GROUP BY ALL", "er AS (SELECT * FROM s WHERE status = '2')", errors),
        "duration_by_attribute": _q("SELECT group_key, bucket, count(*) AS n, round(quantile_cont(dur_us, 0.5), 6) AS p50, round(quantile_cont(dur_us, 0.9), 6) AS p90, round(quantile_cont(dur_us, 0.99), 6) AS p99 FROM kx GROUP BY ALL", keys),
        "report_rate_by_attribute": _q("SELECT group_key, round(mape, 6) AS mape, round(fidelity, 6) AS fidelity, weight FROM report", _base_head("count(*)", scale=4.0, entries=_ATTRIBUTE_ENTRIES)),
        "posting_counts": _q("SELECT group_key, count(*) AS n FROM kx GROUP BY ALL", keys),
        "context_by_attribute": _tree("""SELECT d.group_key, d.n, round(d.depth, 6) AS avg_depth, round(coalesce(1 - w.w / w.total, 0), 6) AS shared_edge_rate
            FROM (SELECT group_key, count(*) AS n, avg(coalesce(far, 0)) AS depth FROM kx LEFT JOIN dp USING (trace_id, span_id) GROUP BY group_key) d
            LEFT JOIN (SELECT group_key, sum(w)::double AS w, sum(total)::double AS total FROM (SELECT group_key, p_feature, feature, count(*) AS w FROM kx JOIN pe USING (trace_id, span_id) GROUP BY ALL)
                       JOIN (SELECT p_feature, feature, count(*) AS total FROM pe GROUP BY ALL) USING (p_feature, feature) GROUP BY group_key) w USING (group_key)""",
            _UP, any_keys(_ATTRIBUTE_ENTRIES, columns="trace_id, span_id"),
            "dp AS (SELECT trace_id, span_id, max(distance) AS far FROM up GROUP BY ALL)",
            """pe AS (SELECT DISTINCT trace_id, span_id, p_feature, feature FROM (SELECT trace_id, span_id, p_feature, feature FROM x
                UNION ALL SELECT up.trace_id, up.span_id, x.p_feature, x.feature FROM up JOIN x ON x.trace_id = up.trace_id AND x.span_id = up.ancestor))""", recursive=True),
        "proto_scan": _q("""SELECT md5(trace_id) AS trace_id, substr(md5(span_id), 1, 16) AS span_id, substr(md5(parent_span_id), 1, 16) AS parent_span_id,
            service, operation, kind, status, start_us, dur_us, k FROM s"""),
        "step_timings": _q(" UNION ALL ".join(
            f"SELECT '{n}' AS step, 'compression' AS phase, count(*) AS rows, coalesce(sum({_SIZE}), 0)::bigint AS bytes, true AS timed FROM s WHERE {w}"
            for n, w in (("all", "TRUE"), ("head_4", _HEAD.format(n=4)), ("tail", "trace_id IN (SELECT trace_id FROM cc WHERE interesting)"))), _TAIL),
        "scalability": _q(" UNION ALL ".join(
            f"SELECT {n}::bigint AS n, count(DISTINCT trace_id) AS traces, count(*) AS spans, sum({_SIZE})::bigint AS raw_bytes, true AS trained, true AS timed FROM s "
            f"WHERE trace_id IN (SELECT trace_id FROM (SELECT DISTINCT trace_id FROM s) ORDER BY md5(trace_id || ':42'), trace_id LIMIT {n})" for n in (20, 60))),
        "relay_types": _tree("""SELECT count(*) AS types, sum((most = 0)::int)::bigint AS leaf, sum((most = 1)::int)::bigint AS single, sum((most > 1)::int)::bigint AS variable,
            sum((most > 1 AND calls >= 2 AND oc > 0.5::double * calls)::int)::bigint AS one_set, sum((most > 1 AND calls >= 2 AND mc > 0.5::double * calls)::int)::bigint AS one_multiset,
            round(100.0::double * sum((most = 0)::int) / count(*), 6) AS leaf_percent, round(100.0::double * sum((most = 1)::int) / count(*), 6) AS single_percent, round(100.0::double * sum((most > 1)::int) / count(*), 6) AS variable_percent
            FROM (SELECT f.feature, coalesce(max(z), 0) AS most, coalesce(sum(c), 0) AS calls, max(c) AS mc, max(oc) AS oc FROM (SELECT DISTINCT feature FROM s) f LEFT JOIN oo USING (feature) GROUP BY f.feature)""",
            "kd AS (SELECT trace_id, parent_span_id, p_feature AS feature, list_sort(list(feature)) AS l FROM x GROUP BY ALL)",
            "mm AS (SELECT feature, l, list_sort(list_distinct(l)) AS o, count(*) AS c, len(l) AS z FROM kd GROUP BY ALL)",
            "oo AS (SELECT *, sum(c) OVER (PARTITION BY feature, o) AS oc FROM mm)"),
        "volume": _q(f"""SELECT bytes, round(w, 9) AS window_s, round(bytes / w * 86400 / 1099511627776.0::double, 9) AS tib_a_day, round(bytes / w * 86400 / 1099511627776.0::double * 1024 * 30 * 0.1::double, 9) AS dollars_a_month
            FROM (SELECT sum({_SIZE})::bigint AS bytes, (max(start_us) - min(start_us)) / 1e6::double AS w FROM s)"""),
        "failure_sections": _sections(),
        "offset_percentiles": _offset_percentiles(),
        "paths_of_five": """WITH c AS (SELECT conv_id, turn, 'kind=SERVER;operation=turn;service=' || role || ';status=0' AS f FROM conversations)
            SELECT a.conv_id || '-' || a.turn AS span_id, e.f || '>' || d.f || '>' || c.f || '>' || b.f || '>' || a.f AS path FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
            JOIN c ON c.conv_id = a.conv_id AND c.turn = a.turn - 2 JOIN c d ON d.conv_id = a.conv_id AND d.turn = a.turn - 3 JOIN c e ON e.conv_id = a.conv_id AND e.turn = a.turn - 4""",
        "trace_chunks": _q("SELECT span_id, (dense_rank() OVER (ORDER BY trace_id) - 1) // 50 AS chunk FROM s"),
        "flat_attributes": _tree("""SELECT a.span_id, t.depth, coalesce(p.service, '') AS parent_service, a.siblings, a.start_us - a.trace_start AS start_offset_us, coalesce(a.k, '') AS k
            FROM a JOIN tree t USING (trace_id, span_id) LEFT JOIN s p ON p.trace_id = a.trace_id AND p.span_id = a.parent_span_id""", _DEPTH, recursive=True),
        "model_merged": whole,
        "model_store": whole,
    }
