"""HTML extraction, toxicity, line quality, fingerprints and repeats."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lumispan.llm import fingerprints, html_text, line_quality, queries, repeats, toxicity

from . import brute

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


PAGE = """<html><head><title>T</title><style>p {}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home page of the site</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this page.</div>
<main><article><h1>A  title &amp; more of it</h1><p>The first   paragraph is <b>bold</b> and it has
many words that say what the article is about.</p><p>&Uuml;ber uns &#8212; und was es ist.</p>
<aside>Buy this now, it is the best that there is.</aside><script>var a = "<p>no</p>";</script>
<form><label>Your name</label></form></article></main>
<section id="comments"><p>I think that this is a very good article and I like it a lot.</p></section>
<footer>Copyright</footer></body></html>"""


def test_html_rules():
    assert html_text.extract(PAGE) == (
        "A title & more of it\n\nThe first paragraph is bold and it has many words that say what the article is about."
        "\n\nÜber uns — und was es ist."
    )


def test_html_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", PAGE, "x"), (4, "u", "<div><p>never closed " + "and the words are of it " * 20_000, "x"), (5, "u", "<a <b>< <!-- ", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    assert out[1]["text"] == out[2]["text"] == "" and out[1]["n_chars"] == 0
    assert out[None]["text"].startswith("A title") and out[4]["n_chars"] > 400_000
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert html_text.main_text(pages.where("page_id < 0")).count() == 0


def test_html_against_the_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    made = [
        "<body><div class=cookie-banner>We use the cookies of this site to be good to you and it is so on all of them.</div><main><h2>One</h2><p>" + "the words of it and that are in the block " * 3 + "</p><ul><li><a href=x>a link</a><li>an item</ul></main>",
        "<div>" + "woord zonder bekende taal " * 5 + "</div><div>kort</div>",
        "<article><div class='widget-text'><p>" + "the and of to be in it was " * 6 + "</p></div><header class='article-header'><h1>T one two</h1></header><div class=comments><p>" + "the and of to " * 9 + "</p></div></article>",
        "<article><p>" + "これは記事の本文です。" * 12 + "</p></article><footer>" + "the and of it " * 9 + "</footer>",
    ]
    prose = "<p>" + "It was said that the words of this block are good to have and that more of them are to come. " * 3 + "</p>"
    made += [x % (prose * 2) for x in FRAMES]
    made += [
        f"<form id=f><nav><a href=x>a</a></nav>{prose * 3}<div class=comments>{prose * 9}</div><footer>{prose}</footer></form>",
        f"<div class=sidebar>{prose}</div><div class=comments>{prose * 2}</div>", f"<form>{prose}</form><form>{prose * 2}</form>{prose}",
        f"<div class=promo>{prose}<div class=ads>{prose * 9}<select>{prose}</select></div></div>", f"<div hidden>{prose}</div>",
    ]
    for html in [r["html"] for r in pages] + made:
        assert html_text.extract(html) == brute.main_text(html), html and html[:300]
    assert "T one two" in html_text.extract(made[2]) and html_text.extract(made[2]).count("\n\n") == 1
    assert html_text.extract(made[1]).startswith("woord") and html_text.extract(made[3]).startswith("これは")


FRAMES = (
    "<form id=aspnetForm>%s</form>", "<div id=page class='no-sidebar'><article>%s</article></div>", "<div class='layout with-sidebar'><main>%s</main></div>",
    "<div class='ad-free'>%s</div>", "<article class='post has-comments'>%s</article>", "<div class=newsletter><form>%s</form></div>", "<div>%s</div>",
)


def test_html_frames_of_a_whole_article_are_not_apart():
    prose = "<p>" + "The article that is in here was written for all of those who like to read and it is long. " * 3 + "</p>"
    want = html_text.extract(f"<body>{prose}{prose}</body>")
    assert len(want) > 500
    rest = "<div class=comments><p>I think that it is the best of all and that we have to say so.</p></div><footer><p>All of the rights to this text are with the owner of the site.</p></footer>"
    for frame in FRAMES:
        assert html_text.extract(f"<body>{frame % (prose * 2)}</body>") == want, frame
        assert html_text.extract(f"<body>{frame % (prose * 2 + rest)}</body>") == want, frame
    assert html_text.extract(f"<body>{prose * 2}<div class=comments>{prose * 20}</div></body>") == want
    assert html_text.extract(f"<body><title>{prose}</title><nav>{prose}</nav></body>") == ""
    for length in (10, 70_000, 300_000):
        assert html_text.extract(f'{prose}<div data-props="a>b {"x" * length}">{prose}</div>') == want


def test_broken_markup_takes_no_longer_than_its_length():
    import time

    start = time.time()
    for html in ("<a " * 70_000, "<script " * 30_000, '<a "' * 50_001 + ">", "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 50_000, "<a '>\"" * 40_000, '<a ">' * 50_001, "<a '\">" * 50_001, "<form>" * 50_000 + "<p>" + "of the and " * 99):
        html_text.extract(html)
    assert time.time() - start < 10


def test_html_open_blocks_follow_their_neighbours():
    prose = "<p>" + "the words of this long block are of the article and it is good to have them in here. " * 2 + "</p>"
    menu = "<ul>" + "".join(f"<li><a href=x>Link number {i} of the menu</a></li>" for i in range(4)) + "</ul>"
    assert "Short line" in html_text.extract(f"<body>{menu}{prose}<p>Short line</p>{prose}{menu}</body>")
    assert "Short line" not in html_text.extract(f"<body>{prose}{menu}<p>Short line</p>{menu}{prose}</body>")


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op9_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = out.groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in n}
    hit, missed, wrong = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert hit / (hit + missed) >= 0.9 and hit / (hit + wrong) >= 0.9, n


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, up = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (x != y)))
        return row[-1]

    terms = ["grumpel", "vortan", "snik", "bladderwort"]
    trie = toxicity.Trie.of(terms)
    model = toxicity.Model(dict.fromkeys(terms, 1.0), [])
    for t in terms:
        words = {t, *[t[:i] + t[i + 1 :] for i in range(len(t))], *[t[:i] + "q" + t[i:] for i in range(len(t) + 1)]}
        words |= {w[:i] + "z" + w[i + 1 :] for w in list(words) for i in range(len(w))}
        for w in words:
            near = [(distance(w, x), x) for x in terms]
            near = [(d, x) for d, x in near if d <= min(toxicity.allowed_edits(len(w)), toxicity.allowed_edits(len(x)))]
            want = (min(near)[1], min(near)[0]) if near else None
            assert toxicity.intersect(trie, w) == want, w
            assert model.lookup(w) == want, w


def test_toxicity_tells_quotation_from_abuse():
    model = toxicity.Model({"grumpel": 4.0}, [])
    abuse = model.features("you are such a grumpell and your friends know it")
    quoted = model.features('the report said that the word "grumpel" was written on the wall')
    assert abuse[0] > 0 == abuse[1] and quoted[1] > 0 == quoted[0]
    assert model.features(None) == model.features("nothing of the kind") == [0.0] * toxicity.Model.FEATURES


def test_toxicity_edges(spark, edges, no_rows):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(edges, labels)
    out = toxicity.score(edges, model).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert toxicity.score(no_rows, toxicity.fit(no_rows, labels)).count() == 0
    assert sorted(toxicity.scored_rows(edges, model).columns) == sorted(edges.columns)


def test_line_quality_against_plain_counts(spark, edges, no_rows):
    docs = edges.select("doc_id", "text", "source").unionByName(documents(spark).select("doc_id", "text", "source"))
    want = sorted(
        (
            -1 if r["doc_id"] is None else r["doc_id"],
            len(w := brute.WORD.findall(r["text"] or "")),
            sum(map(len, w)),
            sum((r["text"] or "").count(c) for c in "#*$%&|<>"),
            len(x := [y for y in (r["text"] or "").split("\n") if brute.WORD.search(y)]) - len(set(x)),
            brute.repeat_words(r["text"]),
        )
        for r in docs.collect()
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = line_quality.line_quality(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *[r[c] for c in names]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert line_quality.line_quality(no_rows).count() == 0


def test_line_quality_rejects_what_shared_lines_deplete(spark):
    line = "this line stands in very many documents of the one host that has it and is noise"
    own = lambda i: " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(12))
    rows = [(i, f"{line}\n{line}!\n{own(i)}" if i % 2 else f"{own(i)} {own(100 + i)}", "h") for i in range(80)]
    rows += [(100 + i, f"{line}\n{own(i)}", "other") for i in range(3)]
    out = {r["doc_id"]: r for r in line_quality.line_quality(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(out[i]["kept"] == (i % 2 == 0) for i in range(80))
    assert all(out[100 + i]["kept"] and out[100 + i]["n_shared_words"] == 0 for i in range(3))


def test_fingerprints(spark, edges, no_rows):
    docs = documents(spark)
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    edited = {}
    for (k, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        h = len(t) // 2
        edited[k] = hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()
    got = fingerprints.edit_probe(docs).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == edited and len(got) == len(rows)
    text = dict(rows)
    prints = {}
    for r in got:
        assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and r["n_chars"] == len(text[r["doc_id"]])
    out = fingerprints.edit_probe(edges).collect()
    assert len(out) == 10 and all(r["edited_sha256"] for r in out)
    assert fingerprints.edit_probe(no_rows).count() == 0
    assert fingerprints.edit_probe(docs.where("doc_id = 0")).first()["near_next"] == 1.0


def test_likeness_of_fingerprints_against_whole_sets(spark):
    docs = documents(spark).where("doc_id is not null").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    sets = [set(brute.shingle_sets(t)) for _, t in rows]
    got = {r["doc_id"]: r for r in fingerprints.edit_probe(docs).collect()}
    off = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = set(brute.shingle_sets(t[: len(t) - len(t) // 2] + after[: len(t) // 2]))
        for found, other in ((got[k]["near_edited"], edited), (got[k]["near_next"], sets[(i + 1) % len(rows)])):
            both = sets[i] | other
            off.append(abs(found - (len(sets[i] & other) / len(both) if both else 1.0)))
    assert max(off) < 0.2 and sum(off) / len(off) < 0.03


def test_ranges_stay_small_where_keys_cluster(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 50)
    keys = [*range(2000), *(10**12 + i * 10**6 for i in range(20)), *(5 * 10**15 + i for i in range(2000))]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "doc_id bigint, text string")
    out = fingerprints.with_next(df, "doc_id", "text", ["text"])
    got = {r["doc_id"]: r["next_text"] for r in out.collect()}
    assert got == {k: str(keys[(i + 1) % len(keys)]) for i, k in enumerate(keys)}


def test_fingerprints_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 3)
    rows = [(k, f"text {i}") for i, k in enumerate([1, 2, 3, 4, 50, 51, 900, 901, 902, 903, 10**9, 10**9 + 1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, "doc_id", "text", ["text"]).collect()}
    assert got == {k: rows[(i + 1) % len(rows)][1] for i, (k, _) in enumerate(rows)}


def test_sketches_merge_and_estimate(spark):
    words = lambda a, z: " ".join(f"w{i}" for i in range(a, z))
    rows = [("a", words(0, 2000)), ("b", words(1000, 3000)), ("c", words(0, 1000))]
    df = spark.createDataFrame(rows, "name string, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    one = {r["name"]: r["s"] for r in df.collect()}
    whole = sorted(set(sum(one.values(), [])))[: fingerprints.K]
    grouped = fingerprints.merged_over(df.withColumn("g", F.lit(1)), ["g"], "s").first()["s"]
    assert grouped == whole
    x = df.where("name = 'a'").select(F.col("s").alias("a")).crossJoin(df.where("name = 'b'").select(F.col("s").alias("b")))
    r = x.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(r["r"] - 1 / 3) < 0.15 and abs(r["c"] - 0.5) < 0.2 and abs(r["n"] / 1996 - 1) < 0.3


@pytest.mark.parametrize("max_group", [20_000, 3])
def test_repeats_against_all_strings(spark, max_group):
    docs = documents(spark).where(F.length("text") < 30_000)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    base = max(rows, key=lambda r: len(r[1]))[1]
    rows += [(10_000 + i, f"{i} é" * i + base[i * 7 : i * 7 + 190 + 10 * i] + "q" * (i * 40)) for i in range(12)]
    rows += [(20_000, "ab" * 300), (20_001, "z" * 250), (20_002, None), (20_003, "")]
    got = {r["doc_id"]: r for r in repeats.digest(spark.createDataFrame(rows, "doc_id bigint, text string"), max_group=max_group).collect()}
    assert len(got) == len(rows)
    for (k, t), mark in zip(rows, brute.repeated_bytes([t for _, t in rows]), strict=True):
        data = (t or "").encode()
        kept = bytes(b for b, m in zip(data, mark, strict=True) if not m)
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), sum(mark), spans), k
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest(), k


def test_repeats_of_a_passage_hotter_than_a_group(spark):
    passage = "".join(chr(97 + (i * i + 3 * i) % 26) for i in range(230))
    rows = [(i, f"{i:05d} own {'xyz'[i % 3] * (i % 40)} {passage} end {i * 7919 % 10_007}") for i in range(9000)]
    rows += [(10_000 + i, passage[i : i + 205]) for i in range(20)] + [(20_000, passage[:199])]
    got = {r["doc_id"]: r for r in repeats.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for (k, t), mark in zip(rows, brute.repeated_bytes([t for _, t in rows]), strict=True):
        kept = bytes(b for b, m in zip(t.encode(), mark, strict=True) if not m)
        assert (got[k]["n_removed"], got[k]["kept_sha256"]) == (sum(mark), hashlib.sha256(kept).hexdigest()), k


def test_repeats_edges(spark, edges, no_rows):
    rows = repeats.without_repeats(edges).collect()
    assert len(rows) == 10 and {r["doc_id"]: r["n_removed"] for r in rows}[6] == 100_000
    assert repeats.digest(edges).count() == 10 and repeats.digest(no_rows).count() == 0


def test_maximal_repeats_list_all_occurrences():
    texts = [b"..xabcab", b".yxabcaz", b"zzabcabc"]
    at = [t.index(b"abc") for t in texts]
    before = [t[:i][::-1] for t, i in zip(texts, at, strict=True)]
    after = [t[i:] for t, i in zip(texts, at, strict=True)]
    found = {(a, z, tuple(sorted(m))) for a, z, m in repeats.maximal_repeats(before, after, 4)}
    assert (1, 4, (0, 1)) in found and any(m == (0, 1, 2) and z == 4 for _, z, m in found) and (0, 5, (0, 2)) in found


def test_next_rows_hold_where_quantiles_come_out_otherwise_each_time(spark, monkeypatch):
    """On a cluster the approximate quantiles differ from one evaluation to the next, as shuffle blocks arrive in any order."""
    exact = F.percentile_approx
    shift = "(CAST(java_method('java.lang.System', 'nanoTime') AS bigint) DIV 1000) % 41"
    monkeypatch.setattr(fingerprints.F, "percentile_approx", lambda *a: F.transform(exact(*a), lambda c: c + F.expr(shift)))
    rows = spark.range(30_000).select((F.col("id") * 3).alias("doc_id"), F.lit("x").alias("text"))
    out = fingerprints.with_next(rows.withColumn("own", F.col("doc_id")), "doc_id", "text", ["own"])
    wrong = out.where(F.col("next_own") != F.pmod(F.col("doc_id") + 3, F.lit(90_000)))
    assert out.count() == 30_000 and wrong.isEmpty()
