"""Near duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

1. Signatures: a text's five-word shingles weigh as often as they occur. Every shingle is a Poisson
   process of that rate; each arrival falls into a random register, and a register keeps the
   shingle of its first arrival. A shingle's process ends at the time by which all registers have
   been reached. Two registers agree with the probability Jaccard similarity of the texts.
2. Copies: texts of equal words are one node from here on, so any number of copies costs one.
3. Banding: 32 bands of 4 registers; nodes that share a band are candidates (at similarity 0.8 a
   pair is missed with probability (1 - 0.8^4)^32, about 5e-8).
4. Verification: the exact probability Jaccard of the whole shingle sets, 0.8 or more.
   A pivot is tested against its bucket's other members first, and linked nodes are merged into
   components. Of what is left, only pairs of different components that the bounds below leave
   possible are listed. What isn't tested is known to be in one class or is unlike by an exact bound,
   so no class is lost.
   Crowded buckets are cut by a prefix filter first. Their nodes' shingles are put in one order,
   rare ones first; two alike nodes share the least of their common shingles, and less than a
   fifth of either's weight stands before it. So each shingle of a prefix is a bucket of its own, whose
   members know the weight b that stands before it in them and that the two can't share.
   Bounds on two members x and y of a bucket, of weights W, where b = 0 in buckets of bands: with
   odds o = b / (W - b) the similarity is at most 1 / (1 + o_x + o_y); with c the lesser of the W - b,
   and h the share of a node's weight on shingles that occur in it more than once, it is at most
   c / (W_x + W_y - c) + h_x + h_y. A pivot is the member of least odds.
5. Classes: connected components of links plus copies, named by their least key.

Nodes are named by a 128-bit hash of their words, not by their keys, so rows whose ids clash stay apart.

Edge cases: null text counts as empty, and texts without words are copies of one another; a text of
fewer than five words is one shingle; rows with a null key get the class of their text, null where
no row of it has a key; repeated rows share their class; where texts that aren't alike have one
key, their classes have the same class_id and different class_hash; an empty table gives no rows;
extra columns are dropped. Words are what white space separates, in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_memo, written
from .components import components

WIDTH = 5
BANDS, ROWS = 32, 4
SIMILARITY = 0.8
MEMO = 200_000
#: Distinct shingles that one numpy pass holds.
PASS = 300_000
#: Candidates (some 100 bytes each) up to which they are broadcast; beyond that the join shuffles.
BROADCAST_KEYS = 200_000
PIVOT_SALTS = 4
#: Pairs that Python is handed at a time: each brings two shingle sets.
VERIFY_ROWS = 250
#: Members from which a bucket is crowded: its nodes meet by the shingles of their prefixes instead.
CROWDED = 32

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finisher of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Hashes of words, kept in a bounded memo, and of shingles."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = worker_memo("words")

    def word_hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, words), dtype=_U, count=len(words))
        except KeyError:
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(memo.__getitem__, words), dtype=_U, count=len(words))

    @staticmethod
    def shingles(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles, increasing, and how often each occurs."""
        n = max(1, len(h) - WIDTH + 1) if len(h) else 0
        s = np.zeros(n, dtype=_U)
        with np.errstate(over="ignore"):
            for j in range(min(WIDTH, len(h))):
                s = s * _U(0x9E3779B97F4A7C15) + h[j : j + n]
            return np.unique(_mix(s), return_counts=True)


def signatures(shingles: list[np.ndarray], weights: list[np.ndarray], registers: int) -> np.ndarray:
    """ProbMinHash signatures, a row of 32-bit shingle marks per text; -1 rows' worth of ones where a
    text has no shingle."""
    sizes = np.array([len(s) for s in shingles])
    e = np.concatenate(shingles) if len(shingles) else np.zeros(0, dtype=_U)
    w = (np.concatenate(weights) if len(weights) else np.zeros(0)).astype(float)
    d = np.repeat(np.arange(len(sizes)), sizes)
    empty = np.iinfo(_U).max
    q = np.full(len(sizes) * registers, empty, dtype=_U)
    with np.errstate(over="ignore"):
        mark = _mix(e ^ _U(0xA0761D6478BD642F)) & _U(0xFFFFFFFF)
        x = np.zeros(len(e))
        turn = 0
        while len(e):
            turn += 1
            r = _mix(e + _U(turn) * _U(0x9E3779B97F4A7C15))
            x += -np.log(((r >> _U(11)).astype(float) + 0.5) / 2.0**53) / w
            register = (_mix(r ^ _U(0xE7037ED1A0B428DB)) % _U(registers)).astype(np.int64)
            arrival = (x.astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | mark
            np.minimum.at(q, d * registers + register, arrival)
            last = q.reshape(-1, registers).max(axis=1)
            # A process goes on while its time is before the latest register's; until all are reached, always.
            alive = (x.astype(np.float32).view(np.uint32).astype(_U) << _U(32)) < last[d]
            e, w, d, mark, x = e[alive], w[alive], d[alive], mark[alive], x[alive]
    return (q & _U(0xFFFFFFFF)).astype(np.uint32).reshape(-1, registers)


def band_keys(marks: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = marks.reshape(len(marks), BANDS, ROWS).astype(_U)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0xD6E8FEB86659FD93), parts.shape[:2])
        for j in range(ROWS):
            key = _mix(key + parts[:, :, j])
        return key.view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact: the sum over common shingles of 1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio, inverse = np.unique(y / x, return_inverse=True)
    # Shingles of the union by their ratio b / a: those up to t count a * t, those above count b.
    mass_a = np.cumsum(np.bincount(inverse, weights=x)) + only_a
    mass_b = y.sum() - np.cumsum(np.bincount(inverse, weights=y)) + only_b
    total = mass_a * ratio + mass_b
    return float((y / total[inverse]).sum())


def packed(s: np.ndarray, c: np.ndarray) -> bytes:
    """A shingle set as bytes: how many occur more than once, which and how often, then all."""
    more = np.flatnonzero(c > 1)
    head = np.array([len(more)], dtype="<u4")
    return head.tobytes() + more.astype("<u4").tobytes() + c[more].astype("<u4").tobytes() + s.astype("<u8").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    at, count = np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, "<u4", n, 4 + 4 * n)
    s = np.frombuffer(data[4 + 8 * n :], "<u8")
    c = np.ones(len(s), dtype=np.int64)
    c[at] = count
    return s, c


def content_of(h: np.ndarray) -> bytes:
    """128 bits that name a sequence of words."""
    return xxhash.xxh3_128_digest(h.tobytes())


def signed(rows: DataFrame) -> DataFrame:
    """From key, text_hash, text: key, text_hash, content, bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            content: list[bytes] = []
            bands: list[np.ndarray] = []
            sets: list[np.ndarray] = []
            weights: list[np.ndarray] = []
            waiting = 0

            def settle() -> None:
                nonlocal waiting
                if sets:
                    bands.extend(band_keys(signatures(sets, weights, BANDS * ROWS)))
                sets.clear()
                weights.clear()
                waiting = 0

            for body in batch["text"]:
                h = shingler.word_hashes(body)
                s, c = shingler.shingles(h)
                content.append(content_of(h))
                sets.append(s)
                weights.append(c)
                waiting += len(s)
                if waiting > PASS:
                    settle()
            settle()
            yield pd.DataFrame({"key": batch["key"], "text_hash": batch["text_hash"], "content": content, "bands": bands})

    kind = dict(rows.dtypes)["key"]
    return rows.mapInPandas(run, f"key {kind}, text_hash bigint, content binary, bands array<bigint>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """From node and text: node, set (the packed shingle set), weight (shingles, each as often as it occurs), heavy (the
    share of those that occur more than once)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            found = [shingler.shingles(shingler.word_hashes(t)) for t in batch["text"]]
            weight = [float(c.sum()) for _, c in found]
            heavy = [float(c[c > 1].sum()) / w if w else 0.0 for (_, c), w in zip(found, weight, strict=True)]
            yield pd.DataFrame({"node": batch["node"], "set": [packed(*f) for f in found], "weight": weight, "heavy": heavy})

    return rows.select("node", "text").mapInPandas(run, "node binary, set binary, weight double, heavy double")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is high enough. A pivot is the a of many pairs, which Spark
    splits over tasks where one has too many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep, name, held = [], None, None
            for a, x, y in zip(batch["a"], batch["x"], batch["y"], strict=True):
                if a != name:
                    name, held = a, unpacked(x)
                keep.append(probability_jaccard(*held, *unpacked(y)) >= similarity)
            yield batch.loc[keep, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", "x", "y").mapInPandas(run, "a binary, b binary")


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """Per node and shingle of its prefix, in the order of how many nodes of ``sets`` hold a shingle: bucket (the
    shingle), node, before (the weight of the node's shingles that come earlier), weight, heavy. Shingles that one
    node alone holds come first and make no bucket."""

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(held: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(
                {
                    "shingle": np.concatenate([s for _, s, _ in held]).view(np.int64),
                    "node": np.repeat(np.array([k for k, _, _ in held], dtype=object), [len(s) for _, s, _ in held]),
                    "times": np.concatenate([c for _, _, c in held]),
                }
            )

        for batch in batches:
            held, waiting = [], 0
            for node, data in zip(batch["node"], batch["set"], strict=True):
                s, c = unpacked(data)
                if len(s):
                    held.append((node, s, c))
                    waiting += len(s)
                if waiting > PASS:
                    yield frame(held)
                    held, waiting = [], 0
            if held:
                yield frame(held)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, weight, heavy, n, shingle, times in batch.itertuples(index=False, name=None):
                order = np.lexsort((shingle, n))
                before = weight - times.sum() + np.cumsum(times[order]) - times[order]
                keep = before <= (1 - similarity) * weight + 1e-6
                rows = {"bucket": shingle[order][keep], "before": before[keep]}
                out.append(pd.DataFrame(rows).assign(node=node, weight=weight, heavy=heavy))
            yield pd.concat(out)[["bucket", "node", "before", "weight", "heavy"]]

    rows = sets.select("node", "set").mapInPandas(postings, "shingle bigint, node binary, times bigint")
    rows = written(rows, "postings")
    # Written, so that the join is of plain shuffles and a shingle of very many nodes can be split.
    holders = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "holders")
    shared = rows.join(holders.hint("shuffle_merge"), "shingle").groupBy("node")
    shared = shared.agg(F.collect_list(F.struct("n", "shingle", "times")).alias("shared"))
    rows = sets.select("node", "weight", "heavy").join(shared, "node")
    rows = rows.select("node", "weight", "heavy", *[F.col(f"shared.{c}").alias(c) for c in ("n", "shingle", "times")])
    return rows.mapInPandas(cut, "bucket bigint, node binary, before double, weight double, heavy double")


def linked(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Node and component of all nodes that have a link. members: bucket, node, before, weight, heavy."""
    limit = 1 / similarity - 1 + 1e-6
    rest = F.col("weight") - F.col("before")
    members = written(
        members.select(
            "bucket", "node", F.when(rest > 0, F.col("before") / rest).otherwise(0.0).alias("odds"), rest.alias("rest"), "weight", "heavy"
        ),
        "members",
    )
    names = {"node": "a", "odds": "_o", "rest": "_r", "weight": "_w", "heavy": "_h"}
    common = F.least("rest", "_r")
    alike = (F.col("odds") + F.col("_o") <= limit) & (
        common >= (similarity - 1e-6 - F.col("heavy") - F.col("_h")) * (F.col("weight") + F.col("_w") - common)
    )
    # A pivot for each bucket: the member of least odds. Written, so that the join with a bucket of very many members is of
    # plain shuffles, which Spark can split.
    order = F.xxhash64("node", F.pmod("bucket", F.lit(PIVOT_SALTS)))
    least = F.min(F.struct("odds", order.alias("o"), "node", "rest", "weight", "heavy"))
    pivots = members.groupBy("bucket").agg(least.alias("p")).select("bucket", *[F.col(f"p.{x}").alias(y) for x, y in names.items()])
    pairs = members.join(written(pivots, "pivots").hint("shuffle_merge"), "bucket").where((F.col("node") != F.col("a")) & alike)
    links = written(verified(pairs.select("a", F.col("node").alias("b")).distinct(), sets, similarity), "links", VERIFY_ROWS)
    found = components(links)
    # What is left: members of one bucket in different components that the bounds leave possible.
    rows = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = written(rows, "members")
    open_ = rows.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.min("odds").alias("_least"))
    open_ = written(open_.where("_lo <> _hi").select("bucket", "_least"), "open")
    rows = rows.join(open_.hint("shuffle_merge"), "bucket").where(F.col("odds") + F.col("_least") <= limit).drop("_least")
    rows = written(rows, "members")
    other = rows.select("bucket", F.col("component").alias("_c"), *[F.col(x).alias(y) for x, y in names.items()])
    pairs = rows.join(other.hint("shuffle_merge"), "bucket").where((F.col("a") < F.col("node")) & (F.col("component") != F.col("_c")) & alike)
    more = written(verified(pairs.select("a", F.col("node").alias("b")).distinct(), sets, similarity), "links", VERIFY_ROWS)
    return components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """Per row: key, text_hash (xxHash64 of its text), class_id (the least key of its class), class_hash (names
    the class, whatever the keys), is_first (the row has the least key and, among the texts of that key, the least text_hash)."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    marked = written(signed(rows), "signatures")
    least = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "text_hash")).alias("least")
    nodes = written(marked.groupBy("content").agg(least, F.first("bands").alias("bands")), "nodes")
    banded = nodes.select(F.col("content").alias("node"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = written(shared, "buckets")
    members = written(banded.join(shared, "bucket"), "members")
    wanted = nodes.join(members.select(F.col("node").alias("content")).distinct(), "content", "left_semi")
    wanted = written(wanted.select(F.col("content").alias("node"), F.col("least.key").alias("_k"), F.col("least.text_hash").alias("_h")), "candidates")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    candidates = rows.join(side, F.col("key").eqNullSafe(F.col("_k")) & (F.col("text_hash") == F.col("_h")))
    sets = written(shingle_sets(candidates.select("node", "text").dropDuplicates(["node"])), "sets")
    facts = sets.select("node", "weight", "heavy")
    few = members.where(F.col("_n") < CROWDED).join(facts, "node").withColumn("before", F.lit(0.0))
    crowd = members.where(F.col("_n") >= CROWDED).select("node").distinct()
    many = prefixes(sets.join(crowd, "node", "left_semi"), similarity)
    columns = ["bucket", "node", "before", "weight", "heavy"]
    found = linked(few.select(columns).unionByName(many.select(columns)), sets, similarity)
    # Classes of more than one node: the least of theirs, then back to each of them.
    joined = written(found.join(nodes.select(F.col("content").alias("node"), "least"), "node"), "linked")
    names = joined.groupBy("component").agg(F.min("least").alias("_least"))
    renamed = joined.join(names, "component").select(F.col("node").alias("content"), "component", "_least")
    classes = nodes.join(renamed, "content", "left").select(
        "content", F.coalesce("component", "content").alias("component"), F.coalesce("_least", "least").alias("least")
    )
    out = marked.select("key", "text_hash", "content").join(classes, "content")
    first = F.col("key").eqNullSafe(F.col("least.key")) & (F.col("text_hash") == F.col("least.text_hash"))
    return out.select(
        F.col("key").alias(key), "text_hash", F.col("least.key").alias("class_id"), F.lower(F.hex("component")).alias("class_hash"), first.alias("is_first")
    )
