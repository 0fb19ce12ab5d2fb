"""Near duplicates, source mix, packing, sharding and the pipeline, and the SQL of the queries."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lumispan.llm import near_dedup, packing, queries, sharding, source_mix

from ..oracle import connect, differences
from . import brute

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SQL = queries.oracle_sql()


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), SQL[name], SF) == []


def test_near_duplicates_against_all_pairs(spark):
    docs = documents(spark).select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = next(t for _, t in rows if t and 100 < len(t.split()) < 300).split()
    for i in range(60):  # a large group of near copies, and chains that only links hold together
        rows.append((10_000 + i, " ".join([*base[:40], f"new{i}", *base[41:]])))
    rng = np.random.default_rng(11)
    for i in range(90):  # copies with few to many edits, some far from all others, some edited alike
        words = list(base)
        for j in rng.integers(0, len(base), 1 + i % 12):
            words[j] = f"edit{i if i % 5 else 0}x{j}"
        rows.append((15_000 + i, " ".join(words)))
    for i in range(8):
        rows.append((20_000 + i, " ".join(base[i * 3 : i * 3 + 60])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = near_dedup.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute.near_classes(rows)
    assert len(out) == len(rows) and all(r["is_first"] == (r["doc_id"] == r["class_id"]) for r in out)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(7)
    e = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.unique(e[:300]), np.unique(e[100:])
    wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    s = near_dedup.signatures([a, b], [wa, wb], 4096)
    exact = near_dedup.probability_jaccard(a, wa, b, wb)
    plain = brute.probability_jaccard(Counter(dict(zip(a.tolist(), wa.tolist()))), Counter(dict(zip(b.tolist(), wb.tolist()))))
    assert abs(exact - plain) < 1e-12 and abs((s[0] == s[1]).mean() - exact) < 0.04


def test_near_duplicates_edges(spark, edges, no_rows):
    out = near_dedup.near_duplicates(edges).collect()
    found = {r["doc_id"]: r["class_id"] for r in out}
    assert len(out) == 10 and found[7] == 1 and found[2] == found[3] == found[4] == 2 and found[None] is None
    assert near_dedup.near_duplicates(no_rows).count() == 0


def test_mix_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 50}, {"x": 7}, {"a": 0, "b": 0}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 90}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in source_mix.source_targets(df).collect()}
        want = brute.level_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-5 for s in sizes), (sizes, got, want)


def test_mix_takes_what_the_targets_say(spark, edges, no_rows):
    for docs in (documents(spark), edges):
        plan = source_mix.mixed(docs).collect()
        assert len(plan) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in plan)
    plan = source_mix.mixed(documents(spark)).join(documents(spark).select("doc_id", "source"), "doc_id").collect()
    taken, target = Counter(), {}
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert source_mix.mixed(no_rows).count() == 0 and source_mix.training_order(no_rows).count() == 0


def test_training_order_holds_the_taken_words(spark):
    docs = documents(spark)
    plan = source_mix.mixed(docs)
    rows = source_mix.training_order(docs)
    assert rows.columns == [*docs.columns, "turn", "position"]
    total = rows.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).first()["n"]
    assert total == plan.agg(F.sum("taken").alias("n")).first()["n"]
    at = [r["position"] for r in rows.select("position").collect()]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1


def test_mix_is_read_off_the_texts_of_the_mix_in_order(spark, monkeypatch):
    tables = {}

    def kept(df, name):
        tables[name] = df.collect()
        return source_mix_written(df, name)

    source_mix_written = source_mix.written
    monkeypatch.setattr(source_mix, "written", kept)
    plan = source_mix.mixed(documents(spark)).collect()
    mix = [r for r in tables["mix-order"] if r["turn"]]
    at = [r["position"] for r in mix]
    assert at == sorted(at) and len(mix) == sum((r["taken_1"] > 0) + (r["taken_2"] > 0) for r in plan)
    # A mix without its last words takes fewer words: nothing but its texts says what is taken.
    pieces = source_mix.first_words
    monkeypatch.setattr(source_mix, "first_words", lambda text, size, taken: pieces(text, size, taken - 1))
    cut = {r["doc_id"]: r["taken_1"] for r in source_mix.mixed(documents(spark)).collect()}
    assert all(cut[r["doc_id"]] == max(0, r["taken_1"] - 1) for r in plan)


def test_copies_of_a_row_take_their_own_turns(spark):
    rows = [(1, "a b c d", s) for s in "xyz" for _ in range(9)] + [(None, None, "x"), (None, "e f", None), (None, "e f", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = source_mix.mixed(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in plan) == Counter((k, len((t or "").split())) for k, t, _ in rows)
    mix = source_mix.training_order(docs).collect()
    got = Counter((r["doc_id"], len(r["text"].split()), r["turn"], r["position"]) for r in mix)
    want = Counter((r["doc_id"], r[f"taken_{i}"], i, r[f"position_{i}"]) for r in plan for i in (1, 2) if r[f"taken_{i}"])
    assert got == want


def ids_of(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_run_encoder_equals_the_tokenizer(spark):
    texts = [r["text"] for r in documents(spark, "/root/testdata/sf0.01").select("text").collect()]
    rng = np.random.default_rng(3)
    marks = list("aZé.,!?'\"-_/\\()0123456789 \t\r\n  ​́ßİŞ\U0001f600中文#@&<>|[]") + ["[UNK]", "<s>", "</s>", "<|endoftext|>", "<|ENDOFTEXT|>", "...", "don't", "Mr."]
    texts += ["".join(rng.choice(marks, rng.integers(1, 60))) for _ in range(3000)]
    own = packing.RunEncoder(TOKENIZER, 0)
    for t, want in zip(texts, ids_of(texts), strict=True):
        assert own(t or "") == np.array(want, dtype="<u4").tobytes(), repr(t)[:200]


@pytest.mark.parametrize("table", ["documents", "edges", "empty"])
def test_packing_is_whole(spark, edges, no_rows, table):
    docs = {"documents": documents(spark), "edges": edges, "empty": no_rows}[table]
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = Counter()
    for (k, _), ids in zip(texts, ids_of([t for _, t in texts]), strict=True):
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[k, i, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    if table == "documents":
        assert len(held) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_packing_solves_hard_histograms():
    for counts in ({1025: 10, 1023: 10}, {683: 30, 682: 30, 684: 2}, {700: 9, 600: 9, 748: 9}, {2048: 3}, {1: 5000}, {}):
        configs = packing.solve(counts, 2048)
        got = Counter()
        for config, times in configs:
            assert sum(a * c for a, c in config) <= 2048
            for a, c in config:
                got[a] += c * times
        assert got == Counter(counts)
        assert sum(t for _, t in configs) <= -(-sum(a * c for a, c in counts.items()) // 2048) + 1


def test_bounds_and_packings_of_awkward_lengths():
    size = lambda configs: sum(times for _, times in configs)
    for lo, hi, n, apart in ((600, 899, 3000, 0.05), (400, 1099, 20_000, 0.025), (690, 1030, 5000, 0.0)):
        values, times = np.unique(np.random.default_rng(1).integers(lo, hi + 1, n), return_counts=True)
        counts = dict(zip(values.tolist(), times.tolist(), strict=True))
        configs = packing.solve(counts, 2048)
        held = Counter()
        for config, k in configs:
            assert sum(a * c for a, c in config) <= 2048
            held.update({a: c * k for a, c in config})
        assert held == counts
        bound, prices = packing.ascended(counts, 2048, np.inf)
        lengths = np.array(sorted(counts))
        value, _ = packing.best_fill(lengths, prices, 2048)
        assert value[2048] <= 1 + 1e-9 and float(prices @ np.array([counts[x] for x in lengths])) >= bound - 1e-6
        assert bound <= size(configs) <= (1 + apart) * np.ceil(bound - 1e-6), (lo, hi)
        assert size(configs) <= size(packing.rounded({}, counts, 2048))


def test_packing_never_loses_to_best_fit():
    rng = np.random.default_rng(1)
    size = lambda configs: sum(t for _, t in configs)
    hard = {1034: 600, 532: 600, 522: 600, 492: 1200}  # best fit takes 1100 sequences, 900 do
    assert size(packing.rounded({}, hard, 2048)) == 1100 and size(packing.solve(hard, 2048)) <= 910
    mid = Counter(rng.integers(400, 1100, 20_000).tolist())
    assert size(packing.solve(mid, 2048)) < size(packing.rounded({}, mid, 2048))
    for counts in (hard, mid, dict.fromkeys(range(1, 2049), 50), Counter(rng.integers(1, 600, 5000).tolist())):
        used, dual = packing.fractional(counts, 2048)
        assert -(-sum(a * c for a, c in counts.items()) // 2048) <= np.ceil(dual - 1e-6) <= size(packing.solve(counts, 2048))
        assert size(packing.solve(counts, 2048)) <= size(packing.rounded({}, counts, 2048))


def test_sharding_laws(spark, edges, no_rows):
    for docs, n in ((documents(spark), 200), (edges, 10)):
        rows = sharding.shard(docs, "doc_id", sharding.uniform_tree(24), sharding.with_shard(sharding.uniform_tree(24))).collect()
        assert len(rows) == docs.count() == n
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        body = {(r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
        assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == body
    assert sharding.shard(no_rows, "doc_id", sharding.uniform_tree(24)).count() == 0


def test_every_added_shard_takes_rows_only_into_itself(spark):
    trees = [sharding.uniform_tree(7)]
    for _ in range(6):
        trees.append(sharding.with_shard(trees[-1]))
    assert [len(sharding.shards_of(t)) for t in trees] == list(range(7, 14))
    ids = spark.range(3000)
    rows = ids.select(*[sharding.descend(t, F.col("id")).alias(f"t{i}") for i, t in enumerate(trees)]).collect()
    for i in range(6):
        moved = [(r[i], r[i + 1]) for r in rows if r[i] != r[i + 1]]
        assert moved and all(to == 7 + i for _, to in moved) and len(moved) < 2 * 3000 / (8 + i)


def test_changed_weights_move_rows_only_below(spark):
    leaf = lambda s, w: sharding.Node(f"s{s}", w, (), s)

    def tree(w):
        racks = [sharding.Node.group(f"g{g}/r", [leaf(2 * g, w if g == 0 else 1.0), leaf(2 * g + 1, 2.0 - w if g == 0 else 1.0)]) for g in range(3)]
        return sharding.Node.group("root", racks)

    ids = spark.range(3000)
    rows = ids.select(sharding.descend(tree(1.0), F.col("id")).alias("a"), sharding.descend(tree(1.5), F.col("id")).alias("b")).collect()
    moved = {(r["a"], r["b"]) for r in rows if r["a"] != r["b"]}
    assert moved == {(1, 0)}  # within the one rack whose weights changed, towards the heavier shard
    share = Counter(r["b"] for r in rows)
    assert abs(share[0] / 3000 - 0.25) < 0.04 and abs(share[4] / 3000 - 1 / 6) < 0.04


def test_pipeline_against_plain_stages(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, SF)
    rows = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    once = stages["near_dedup"](spark, kept, SF)
    classes = brute.near_classes(rows)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(set(classes.values()))
    short = once.where("length(text) < 30000")
    rows = [(r["doc_id"], r["text"] or "") for r in short.collect()]
    want = {}
    for (k, t), mark in zip(rows, brute.repeated_bytes([t for _, t in rows]), strict=True):
        left = bytes(b for b, m in zip(t.encode(), mark, strict=True) if not m).decode("utf-8", "ignore")
        if not any(mark) or brute.WORD.search(left):
            want[k] = left
    got = stages["repeats"](spark, short, SF)
    assert {r["doc_id"]: r["text"] or "" for r in got.collect()} == want
    mixed = stages["source_mix"](spark, got, SF)
    assert mixed.columns == docs.columns
    out = stages["packing"](spark, mixed, SF)
    assert out.agg(F.sum((F.col("piece") == 0).cast("int")).alias("n")).first()["n"] == mixed.count()


def test_pipeline_edges(spark, edges, no_rows, tmp_path):
    for docs in (edges, no_rows):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
            if name == "near_dedup" and docs.count():
                ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
                assert ids == [(False, 1), (False, 2), (False, 5), (False, 6), (False, 8), (True, 0)]
        assert {"sequence_id", "offset"} <= set(docs.columns)


def test_one_id_with_two_texts_keeps_both(spark):
    from lumispan.llm.near_dedup import near_duplicates

    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(7, a), (7, b), (8, a + " more"), (9, b + " more"), (None, a), (None, "a lone text without an id")]
    df = spark.createDataFrame([(k, t, None, "s", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = near_duplicates(df).collect()
    assert len({r["class_hash"] for r in out}) == 3 and sum(r["is_first"] for r in out) == 3
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(7, a), (7, b), (0, "a lone text without an id")])


def test_crowds_against_all_pairs(spark):
    """A group far above CROWDED: few and many edits, shared edits, cuts, repeats, all in one crowd."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(500):
        words = list(base)
        for j in rng.integers(0, len(base), rng.integers(0, 7)):
            words[j] = f"e{j}x{rng.integers(0, 4)}"
        if i % 7 == 0:
            words = words[: rng.integers(60, 120)]
        if i % 11 == 0:
            words += ["over", "and", "over", "again", "now"] * int(rng.integers(1, 30))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = near_dedup.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute.near_classes(rows)
