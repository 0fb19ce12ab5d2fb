"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

LINE_QUALITY = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, 'null') AS host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i+4]) AS n FROM g
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM w
), k AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
         regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]', '0', 'g') AS norm
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY doc_id
), held AS (
  SELECT host, norm, count(DISTINCT text) AS n FROM k GROUP BY host, norm
), hosts AS (
  SELECT host, count(DISTINCT text) AS texts FROM w GROUP BY host
), above AS (
  SELECT host, norm FROM held JOIN hosts USING (host) WHERE n > 20 AND n > 0.002 * texts
), gone AS (
  SELECT doc_id, sum(nw) AS n_shared_words FROM k JOIN above USING (host, norm) GROUP BY doc_id
), r AS (
  SELECT w.doc_id, len(words)::bigint AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
         coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
         coalesce(n_shared_words, 0)::bigint AS n_shared_words
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND n_shared_words <= 0.6 * n_words AND n_words - n_shared_words >= 10 AS kept
FROM r
"""

SOURCE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
         md5(coalesce(doc_id::varchar, 'null')) AS h FROM documents
), p AS (
  SELECT *, ('0x' || substr(h, 1, 8))::bigint % 1024 AS b FROM d
), s AS (
  SELECT source, sum(size)::bigint AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn
  FROM d GROUP BY source
), s2 AS (
  SELECT *, 2.0::double * source_size AS cap, [5.0, 2.0, 1.0][turn + 1]::double AS w, [0.5, 0.0, -0.5][turn + 1]::double AS tilt FROM s
), lv AS (  -- where sum(min(cap, level * w)) meets the demand: between the breakpoints cap / w, checked one by one
  SELECT a.cap / a.w AS bp,
    (SELECT sum(least(b.cap, a.cap / a.w * b.w)) FROM s2 b) AS gives,
    (SELECT coalesce(sum(b.cap), 0) FROM s2 b WHERE b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.source < a.source)) AS full_,
    (SELECT sum(b.w) FROM s2 b WHERE b.cap / b.w > a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.source >= a.source)) AS open_
  FROM s2 a
), one AS (
  SELECT (1.5::double * (SELECT sum(source_size) FROM s2) - full_) / open_ AS common
  FROM lv WHERE gives >= 1.5::double * (SELECT sum(source_size) FROM s2) ORDER BY bp LIMIT 1
), t AS (
  SELECT source, source_size, tilt, round(least(cap, common * w), 6) AS target FROM s2, one
), c AS (
  SELECT p.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY b, h, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM p
), k AS (
  SELECT doc_id, size, source_size, target, tilt, start, start + source_size AS again,
         greatest(0, least(size, floor(target)::bigint - start))::bigint AS t1,
         greatest(0, least(size, floor(target)::bigint - start - source_size))::bigint AS t2
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
), y AS (
  SELECT *, least(greatest(start::double / target, 0), 1) AS y1, least(greatest(again::double / target, 0), 1) AS y2 FROM k
)
SELECT doc_id, size, source_size, target, t1 + t2 AS taken,
  CASE WHEN t1 > 0 THEN round(CASE WHEN tilt = 0 THEN y1 ELSE 2.0::double * y1 / ((1 + tilt) + sqrt(greatest((1 + tilt) * (1 + tilt) - 4.0::double * tilt * y1, 0))) END, 6) END AS position_1,
  CASE WHEN t2 > 0 THEN round(CASE WHEN tilt = 0 THEN y2 ELSE 2.0::double * y2 / ((1 + tilt) + sqrt(greatest((1 + tilt) * (1 + tilt) - 4.0::double * tilt * y2, 0))) END, 6) END AS position_2
FROM y
"""


def _draw(key: str, label: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5({key} || ':{label}'), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double) / {weight}::double"


def _tree(regions: dict[int, dict[int, list[int]]], key: str) -> str:
    """Nested CASEs over winner lists: each level takes the child of the smallest draw."""

    def least(children: list[tuple[str, float]]) -> str:
        pairs = ", ".join(f"{{'d': {_draw(key, label, w)}, 'i': {i}}}" for i, (label, w) in enumerate(children))
        return f"list_min([{pairs}]).i"

    def choose(children: list[tuple[str, float]], below: list[str]) -> str:
        if len(children) == 1:
            return below[0]
        return f"CASE {least(children)} " + " ".join(f"WHEN {i} THEN ({x})" for i, x in enumerate(below)) + " END"

    tops, bodies = [], []
    for g, racks in regions.items():
        names, inner = [], []
        for r, shards in racks.items():
            names.append((f"g{g}/r{r}", float(len(shards))))
            inner.append(choose([(f"s{s}", 1.0) for s in shards], [str(s) for s in shards]))
        tops.append((f"g{g}", float(sum(len(x) for x in racks.values()))))
        bodies.append(choose(names, inner))
    return choose(tops, bodies)


def hash_tree(shards: int = 24) -> str:
    def regions(n: int) -> dict[int, dict[int, list[int]]]:
        out: dict[int, dict[int, list[int]]] = {}
        for s in range(n):
            out.setdefault(s // 12, {}).setdefault(s % 12 // 4, []).append(s)
        return out

    key = "coalesce(doc_id::varchar, 'null')"
    return rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::bigint, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hx FROM documents
), e AS (
  SELECT doc_id, length(hx) // 2 + 8 AS size,
    xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint,
      list_transform(range(length(hx) // 2), lambda j: ('0x' || substr(hx, 2 * j + 1, 2))::bigint)),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS text_crc32,
    ({_tree(regions(shards), key)})::int AS shard, ({_tree(regions(shards + 1), key)})::int AS grown_shard,
    ('0x' || substr(md5({key}), 1, 8))::bigint % 1024 AS b
  FROM d, crc
)
SELECT doc_id, size::bigint AS size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY b, doc_id, size, text_crc32) - 1 AS slot
FROM e
"""


FILL_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::varchar, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), k AS (
  SELECT doc_id, text, u, len(u)::bigint AS n, ('0x' || h[1:8])::bigint % (len(u) + 1) AS a, ('0x' || h[9:16])::bigint % (len(u) + 1) AS b,
         ('0x' || h[17:24])::bigint % 100 AS c, ('0x' || h[25:32])::bigint % 100 AS e
  FROM d
), p AS (
  SELECT doc_id, n, text, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(u[greatest(a, b) + 1:], '') AS suf,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 50 THEN 'plain'
              WHEN e < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(pre)::bigint END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::bigint END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def vector_codes(rounds: int = 4) -> str:
    """Plain full search, round after round; vectors of one length, as the table has them."""

    def assigned(book: str) -> str:
        return f"""
  SELECT vec_id, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
    SELECT x.vec_id, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS dist
    FROM x JOIN {book} b ON x.part = b.part
  ) GROUP BY vec_id, part"""

    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({assigned(f'b{r}')}\n)")
        steps.append(f"""m{r} AS (
  SELECT part, entry, list(s ORDER BY pos) AS v FROM (
    SELECT part, entry, pos, ((sum(val) - ((sum(val) % count(*)) + count(*)) % count(*)) // count(*))::bigint AS s FROM (
      SELECT a.part, a.entry, unnest(range(len(x.v))) AS pos, unnest(x.v) AS val FROM a{r} a JOIN x USING (vec_id, part)
    ) GROUP BY part, entry, pos
  ) GROUP BY part, entry
), b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry
)""")
    chain = ", ".join(steps)
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS v FROM k, (SELECT unnest(range(4)) AS part)
), b0 AS MATERIALIZED (
  SELECT x.part, f.entry, x.v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 256) f USING (vec_id)
), {chain}, z AS MATERIALIZED ({assigned(f"b{rounds}")}
), c AS (
  SELECT vec_id, string_agg(lower(format('{{:02x}}', entry)), '' ORDER BY part) AS code, sum(dist)::bigint AS error FROM z GROUP BY vec_id
), h AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256
FROM k JOIN c USING (vec_id), h
"""


URL_RULES = r"""
WITH r(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), p AS (
  SELECT row_number() OVER () AS row, page_id, url,
         CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] END AS rest FROM pages
), s AS (
  SELECT row, page_id, rest, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM p
), g AS (
  SELECT s.row, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
  FROM s JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY s.row
), t AS (
  SELECT s.row, translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce(regexp_extract(rest, '\?([^#]*)', 1), '') AS query,
         string_split(host, '.') AS labels, host FROM s WHERE rest IS NOT NULL
), w AS (
  SELECT row, unnest(list_transform(range(1, len(labels) + 1), lambda i: 's:' || array_to_string(labels[i:], '.'))) AS token FROM t
  UNION SELECT row, unnest(list_transform(regexp_split_to_array(host, '[.\-_]'), lambda v: 'h:' || v)) FROM t
  UNION SELECT row, unnest(list_transform(regexp_split_to_array(low, '[/.\-_]'), lambda v: 'p:' || v)) FROM t
  UNION SELECT row, 'e:' || regexp_extract(low, '\.([a-z0-9]+)$', 1) FROM t
  UNION SELECT row, unnest(list_transform(string_split(query, '&'), lambda v: 'q:' || regexp_extract(v, '^[^=]*'))) FROM t
), k AS MATERIALIZED (
  SELECT row, token FROM w WHERE regexp_matches(token[3:], '[^0-9]')
), n AS (SELECT count(*) AS n FROM g),
f AS MATERIALIZED (  -- tokens that are frequent among labelled rows
  SELECT token FROM k JOIN g USING (row) GROUP BY token HAVING count(*) >= ceil(0.01::double * (SELECT n FROM n))
), q AS MATERIALIZED (SELECT k.row, k.token FROM k JOIN f USING (token)),
sets AS MATERIALIZED (
  SELECT row, [token] AS tokens FROM q
  UNION ALL SELECT a.row, [a.token, b.token] FROM q a JOIN q b ON a.row = b.row AND a.token < b.token
  UNION ALL SELECT a.row, [a.token, b.token, c.token] FROM q a JOIN q b ON a.row = b.row AND a.token < b.token JOIN q c ON b.row = c.row AND b.token < c.token
), m AS (
  SELECT tokens, count(*) AS seen, count(*) FILTER (verdict = 'block') AS blocked, count(*) FILTER (verdict = 'allow') AS allowed
  FROM sets JOIN g USING (row) GROUP BY tokens
), rules AS (
  SELECT tokens, label, held, held / seen AS confidence FROM (
    SELECT tokens, 'block' AS label, blocked AS held, seen FROM m UNION ALL SELECT tokens, 'allow', allowed, seen FROM m
  ) WHERE held > 0 AND held >= ceil(0.01::double * (SELECT n FROM n)) AND 100 * held >= 80 * seen
), best AS (
  SELECT row, label FROM sets JOIN rules USING (tokens) WHERE row NOT IN (SELECT row FROM g)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY confidence DESC, held DESC, len(tokens), tokens, label) = 1
)
SELECT page_id, host, path, rule, coalesce(g.verdict, best.label, 'allow') AS verdict
FROM s LEFT JOIN g USING (row) LEFT JOIN best USING (row)
"""
