"""Vector codes, fill-in-the-middle and URL rules against plain versions."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispan.llm import fill_middle, url_rules, vector_codes

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def plain_codes(rows, entries=256, rounds=4, parts=4):
    """From (vec_id, vector, label): per row (vec_id, code, error, label), and the codebooks, by full search in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                x = cut(r[1], p)
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    out = []
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    text = ",".join(str(c) for b in books for y in b for c in y)
    return out, hashlib.sha256(text.encode()).hexdigest()


def test_codes_against_full_search(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)], int(i) % 3) for i in rng.permutation(300)]
    rows += [(1000 + i, rows[7][1], None) for i in range(40)]  # copies, without a label
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[4][1], 2)]  # ids that repeat, and none
    rows += [(-1, None, 1), (-2, [0.1] * 7 + [None], 1), (-3, [0.1] * 7 + [NAN], 1), (-4, [INF] + [0.1] * 7, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "'x' code", "'x' vector", "'x' error")
    got = vector_codes.vector_codes(df).collect()
    want, sha = plain_codes(rows)
    sums = Counter()
    for r in want:
        sums[r[3]] += r[2]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got) == sorted(
        (i is None, i or 0, code, error, sums[label]) for i, code, error, label in want
    )
    assert {r["codebooks_sha256"] for r in got} == {sha}


def test_codes_of_other_dimensions_and_large_components(spark):
    rows = [(i, [float(i), 0.0, 1.0, 2.0], 0) for i in range(5)] + [(9, [1.0, 2.0], 0), (10, [], 0), (11, [1e30, -1e30, 3e38, 0.0], 1)]
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert len(got) == 8 and got[9]["code"] is None and got[9]["error"] is None and got[10]["code"] is None
    assert got[11]["error"] == 0 and got[0]["label_error"] == 0 and got[0]["code"] == "00000000"
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], "vec_id bigint, embedding array<float>, label int")
    assert vector_codes.vector_codes(odd).first()["code"] is None
    assert vector_codes.vector_codes(odd.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("n", [1, 5, 256])
def test_approximation_finds_the_nearest_entry(n):
    rng = np.random.default_rng(n)
    entries = rng.integers(-300, 300, (n, 16))
    entries[n // 2 :: 3] = entries[n // 3]  # equal entries: the lowest index wins
    file = vector_codes.Approximation(entries)
    parts = np.concatenate([rng.integers(-500, 500, (400, 16)), entries, np.zeros((3, 16), dtype=np.int64)])
    exact = ((parts[:, None] - entries) ** 2).sum(axis=2)
    lower, upper = file.bounds(parts)
    assert (lower <= exact).all() and (exact <= upper).all()
    code, error = file.nearest(parts)
    assert (code == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
    if n == 256:
        assert (lower <= upper.min(axis=1)[:, None]).sum() < exact.size  # the filter leaves something out


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        form, output = "plain", text
    elif h4 % 100 < 80:
        form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    plain = form == "plain"
    return (
        doc_id is None, doc_id or 0, len(units), form, -1 if plain else len(prefix), -1 if plain else len(middle),
        hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(),
    )


def test_fill_in_middle_against_regular_expressions(spark, edges, no_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = ["<P>", "a <S> b", "x<M", "<P <S <M > <", "a<", "<P\t", "\x1c\x85\xa0 no\u3000blanks here", " ", "\n\n", "a", " a", "a ", "é😀 <😀>\v\f\r\t x", "<<S" * 50, "a <P" * 40]
    rows = [(10_000 + 100 * i + j, t) for i, t in enumerate(odd) for j in range(12)]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")).unionByName(edges.select("doc_id", "text"))
    null = lambda v: -1 if v is None else v
    got = [
        (r["doc_id"] is None, r["doc_id"] or 0, r["n"], r["form"], null(r["prefix_chars"]), null(r["middle_chars"]), r["output_sha256"], r["restored_sha256"])
        for r in fill_middle.digest(docs).collect()
    ]
    want = [plain_middle(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(got) == sorted(want)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digest(edges).count() == 10 and fill_middle.digest(no_rows).count() == 0


def test_outputs_of_the_operator_hold_the_texts(spark, edges):
    rows = fill_middle.fill_in_middle(edges, rewritten=100)
    rows = rows.withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).select("doc_id", "form", "output", "back").collect()
    want = Counter((r["doc_id"], r["text"] or "") for r in edges.collect())
    assert Counter((r["doc_id"], r["back"]) for r in rows) == want
    assert all(r["form"] == "plain" or sorted(re.sub("<[PSM]>", "", r["output"])) == sorted(r["back"]) for r in rows)


def plain_tokens(url):
    if url is None or "://" not in url:
        return "", "", frozenset()
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest).group()
    host = "".join(c.lower() if c.isascii() else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :]).group()
    low = "".join(c.lower() if c.isascii() else c for c in path)
    labels = host.split(".")
    query = re.search(r"\?([^#]*)", rest)
    end = re.search(r"\.([a-z0-9]+)$", low)
    found = [("s:", ".".join(labels[i:])) for i in range(len(labels))] + [("h:", w) for w in re.split(r"[.\-_]", host)] + [("p:", w) for w in re.split(r"[/.\-_]", low)]
    found += [("e:", end.group(1) if end else "")] + [("q:", v.split("=")[0]) for v in (query.group(1) if query else "").split("&")]
    return host, path, frozenset(k + w for k, w in found if re.search("[^0-9]", w))


def plain_verdicts(rows, support=0.01, confidence=80, most=3):
    given = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    parsed = []
    for page, url in rows:
        host, path, tokens = plain_tokens(url)
        fits = [(len(h + p), h + p, v) for h, p, v in given if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parsed.append((page, url, host, path, tokens, *(max(fits)[1:] if fits else (None, None))))
    known = [(t, v) for *_, t, _, v in parsed if v]
    least = math.ceil(support * len(known))
    common = Counter(x for t, _ in known for x in t)
    common = {x for x, n in common.items() if n >= least}
    seen, held = Counter(), Counter()
    for t, v in known:
        for k in range(1, most + 1):
            for c in combinations(sorted(t & common), k):
                seen[c] += 1
                held[c, v] += 1
    rules = [(-n / seen[c], -n, len(c), c, v) for (c, v), n in held.items() if n >= least and 100 * n >= confidence * seen[c]]
    rules.sort()
    out = []
    for page, url, host, path, tokens, rule, verdict in parsed:
        if verdict is None:
            verdict = next((r[4] for r in rules if set(r[3]) <= tokens), "allow")
        out.append((page is None, page or 0, host, path, rule or "", verdict))
    return sorted(out)


def test_url_rules_against_counted_sets(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [
        None, "", "no scheme", "http://", "http://NET/", "http://net", "http://net?x", "https://a.b.Example.NET/en/x?u=http://z.org/fr/",
        "http://badnet/", "x://example.com/de", "x://example.com/de/", "x://q.example.com/de/1#f", "x://org/fr/", "x://W.ORG/fr/a_b-c.HTML?a=1&&b&=2",
        "://:///", "x://y//de/", "http://ÄÖ.net/Ä/", "http://x.com/" + "long/" * 5000, "http://user@host.com:80/en/?page=3#://",
    ]
    rows = [(10_000 + i, u) for i, u in enumerate(odd)] + [(10_000, odd[7]), (None, odd[12]), (1, odd[14]), (1, odd[14])]
    rows += [(20_000 + i, f"https://shop.example.com/fr/{i}") for i in range(50)] + [(20_100 + i, "https://shop.example.com/fr/1") for i in range(50)]
    df = pages.unionByName(spark.createDataFrame(rows, "page_id bigint, url string"))
    got = url_rules.judged(df.selectExpr("*", "'x' host", "'x' tokens", "'x' rule", "'x' label", "'x' given", "'x' `_url`")).collect()
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got)
    assert got == plain_verdicts([(r["page_id"], r["url"]) for r in df.collect()])


def test_url_rules_from_given_labels(spark):
    label = [(f"http://a{i}.com/shop/win-now/{i}", "block") for i in range(30)] + [(f"http://a{i}.com/shop/{i}", "allow") for i in range(60)]
    labels = spark.createDataFrame([*label, (None, "block"), ("http://x.com/", None)], "url string, label string")
    pages = spark.createDataFrame([(1, "http://new.com/win/now/shop"), (2, "http://new.com/win"), (3, "http://new.com/shop/news")], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judged(pages, labels=labels).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
    assert url_rules.judged(pages.where("page_id < 0")).count() == 0
    assert {r["verdict"] for r in url_rules.judged(pages).collect()} == {"allow"}  # nothing labelled, nothing mined
    rules = url_rules.mined_rules(labels.withColumn("tokens", url_rules.tokens_of(F.col("url"), url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")))))
    assert all(r["confidence"] >= 0.8 and r["held"] <= r["seen"] for r in rules.collect())
