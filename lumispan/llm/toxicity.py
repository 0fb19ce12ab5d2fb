"""Toxicity: misspelled lexicon terms by Levenshtein automata, and scores from their contexts.

Fit: a sample of labelled rows (at most ``max_rows``, by hash of the id) gives each word's document
counts by label; words that toxic documents hold far more often become the lexicon. Then the
features of the same sample fit a logistic regression.

Score: every word of a text walks the lexicon's trie in step with its Levenshtein automaton; terms
within the distance that a word's length allows are hits. Around each hit a window of words is
read: quotation marks or reporting words count for quotation, address to a reader and further
hits for abuse. The document's score comes from its hits' weights split by these contexts.

Documents are scored where they lie; only the sample (bounded) meets the driver, as counts and
features. A batch's words are looked up once per distinct word in a bounded memo.

Edge cases: null and empty texts have no hits and score what the model gives for that; a table
without labelled toxic rows scores 0 everywhere; repeated rows give repeated results; a very long text is read whole; ties in the
sample are broken by id, terms of equal odds by their letters; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_memo, written

_WORD = re.compile(r"[^\W_]+(?:['’*@$!1-9][^\W_]+)*", re.U)
WORD_SQL = r"[\p{L}\p{N}]+(?:['’*@$!1-9][\p{L}\p{N}]+)*"
WINDOW = 8
#: Ends a lexicon entry that stands for every word beginning so.
STEM = "*"
STEM_LENGTHS = (4, 5, 6)
# Words that report speech, words that address someone.
REPORTING = frozenset(
    "said says say called calls quoted quote quotes quoting wrote writes written word words term terms slur phrase "
    "sagte nannte zitiert wort dit cité mot dijo palabra cita llamó".split()
)
ADDRESS = frozenset("you your youre u ur yourself du dein deine dich ihr tu toi ton vous votre tú tu usted eres".split())
OPENING, CLOSING = '"“„«', '"”“»'


def is_held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class Trie:
    """A node: children by character, the term that ends here."""

    children: dict[str, "Trie"] = field(default_factory=dict)
    term: str | None = None
    stem: bool = False

    @staticmethod
    def of(terms) -> "Trie":
        root = Trie()
        for t in terms:
            node = root
            for c in t.rstrip(STEM):
                node = node.children.setdefault(c, Trie())
            node.term, node.stem = t, t.endswith(STEM)
        return root


def allowed_edits(length: int) -> int:
    return 0 if length < 4 else 1 if length < 9 else 2


def allowed_stem_edits(length: int) -> int:
    """Fewer than for a word: what follows a stem is free."""
    return 0 if length < 6 else 1


def intersect(trie: Trie, word: str) -> tuple[str, int] | None:
    """The nearest term within the edits that ``word`` allows, and its distance.

    The automaton of ``word`` has states (position, edits); a set of them is kept as the least
    edits per position. Trie and automaton advance together, and a branch ends where no state lives.
    """
    limit, n = allowed_edits(len(word)), len(word)
    best: tuple[int, str] | None = None
    start = {i: i for i in range(min(limit, n) + 1)}
    todo = [(trie, start)]
    while todo:
        node, states = todo.pop()
        if node.stem and states:
            found = (min(states.values()), node.term)
            if found[0] <= allowed_stem_edits(len(node.term) - 1) and (best is None or found < best):
                best = found
        elif node.term is not None and abs(len(node.term) - n) <= limit and n in states:
            found = (states[n], node.term)
            if found[0] <= allowed_edits(len(node.term)) and (best is None or found < best):
                best = found
        for c, child in node.children.items():
            after: dict[int, int] = {}
            for i, e in states.items():
                if i < n and word[i] == c:
                    after[i + 1] = min(e, after.get(i + 1, 99))
                if e < limit:
                    after[i] = min(e + 1, after.get(i, 99))
                    if i < n:
                        after[i + 1] = min(e + 1, after.get(i + 1, 99))
            for i in sorted(after):  # skipping a character of the word
                e = after[i]
                while i < n and e < limit and e + 1 < after.get(i + 1, 99):
                    i, e = i + 1, e + 1
                    after[i] = e
            if after:
                todo.append((child, after))
    return None if best is None else (best[1], best[0])


def pieces(term: str, limit: int) -> list[tuple[int, str]]:
    """``limit`` + 1 parts of a term and where they start: of ``limit`` edits at least one part is free."""
    n = limit + 1
    cuts = [len(term) * k // n for k in range(n + 1)]
    return [(a, term[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


@dataclass
class Model:
    """Terms with their log odds, words that look like terms but aren't, and the regression's weights."""

    lexicon: dict[str, float]
    weights: list[float]
    ordinary: frozenset[str] = frozenset()
    trie: Trie | None = None
    parts: dict[tuple[int, int], set[str]] = field(default_factory=dict)
    memo: dict[str, tuple[str, int] | None] = field(default_factory=dict)

    FEATURES = 5

    def lookup(self, word: str) -> tuple[str, int] | None:
        """The automaton's hit for a word. Words that share no part of a term at a place that the
        edits can reach are ruled out first, which loses nothing."""
        if word in self.lexicon:
            return word, 0
        if word in self.ordinary:
            return None
        if self.trie is None:
            self.trie = Trie.of(self.lexicon)
            for t in self.lexicon:
                plain = t.rstrip(STEM)
                most = allowed_stem_edits(len(plain)) if t.endswith(STEM) else allowed_edits(len(plain))
                for edits in range(0 if t.endswith(STEM) else 1, most + 1):
                    for at, part in pieces(plain, edits):
                        for shift in range(-edits, edits + 1):
                            if at + shift >= 0:
                                self.parts.setdefault((at + shift, len(part)), set()).add(part)
        for (at, size), known in self.parts.items():
            if word[at : at + size] in known:
                return intersect(self.trie, word)
        return None

    def hit(self, word: str) -> tuple[str, int] | None:
        if len(self.memo) > 200_000:
            self.memo.clear()
        found = self.memo[word] = self.lookup(word)
        return found

    def features(self, text: str | None) -> list[float]:
        """Of hits, misspelled ones discounted: the weight told as abuse, the weight told as
        quotation, the weight near address or other hits, the share of words, and whether any."""
        lower = (text or "").lower()
        memo, hit = self.memo, self.hit
        plain = _WORD.findall(lower)
        hits = [(i, h) for i, w in enumerate(plain) if (h := (memo[w] if w in memo else hit(w)))]
        if not hits:
            return [0.0] * self.FEATURES
        words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(lower)]
        abuse = quoted = close = 0.0
        for k, (i, (term, edits)) in enumerate(hits):
            weight = self.lexicon[term] * (1.0, 0.8, 0.5)[edits]
            near = {w for w, _, _ in words[max(0, i - WINDOW) : i + WINDOW + 1]}
            before, after = lower[max(0, words[i][1] - 40) : words[i][1]], lower[words[i][2] : words[i][2] + 40]
            marked = sum(before.count(q) for q in OPENING) % 2 == 1 and any(q in after for q in CLOSING)
            address = not near.isdisjoint(ADDRESS)
            if (marked or not near.isdisjoint(REPORTING)) and not address:
                quoted += weight
            else:
                abuse += weight
            if address or any(0 <= j < len(hits) and abs(hits[j][0] - i) <= 4 * WINDOW for j in (k - 1, k + 1)):
                close += weight
        share = 100.0 * len(hits) / len(plain)
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(close), math.log1p(share), float(abuse > 0)]

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        z = features @ np.array(self.weights[1:]) + self.weights[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> list[float]:
    """Newton's method; x has no constant column."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    max_rows: int = 10_000,
    max_terms: int = 256,
    min_log_odds: float = 2.5,
    min_docs: int = 3,
    min_share: float = 0.02,
) -> Model:
    """Learn from at most ``max_rows`` labelled rows outside the held-out quarter. The lexicon has at
    most ``max_terms`` words and stems (first 4 to 6 letters, marked *): those in ``min_docs`` and ``min_share`` of the toxic documents, with
    smoothed log odds of ``min_log_odds`` or more."""
    usable = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull() & ~is_held_out(F.col(key)))
    usable = usable.groupBy(key).agg(F.max(toxic).alias("_y"))
    chosen = usable.orderBy(F.md5(F.col(key).cast("string")), key).limit(max_rows)
    # The ids of max_rows rows at most: some 16 bytes each.
    sample = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), key)
    # One row per id, however often the table repeats it, so that max_rows holds for what reaches the driver too.
    sample = sample.groupBy(key).agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(WORD_SQL), F.lit(0)))
    stems = lambda k: F.transform(
        F.filter(F.col("_words"), lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit(STEM))
    )
    sample = written(sample.withColumn("_words", words), "toxicity-sample")
    tokens = F.array_distinct(F.concat("_words", *[stems(k) for k in STEM_LENGTHS]))
    totals = {int(r["_y"]): r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model({}, [])
    counts = (
        sample.select("_y", F.explode(tokens).alias("w"))
        .groupBy("w")
        .agg(F.sum("_y").cast("bigint").alias("a"), F.sum(1 - F.col("_y")).cast("bigint").alias("b"))
    )
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    terms = (
        counts.where((F.col("a") >= max(min_docs, min_share * n1)) & (F.length("w") >= 3))
        .withColumn("odds", odds)
        .where(F.col("odds") >= min_log_odds)
        .orderBy(F.desc("odds"), "w")
        .limit(max_terms)
    )
    lexicon = without_covered({r["w"]: float(r["odds"]) for r in terms.collect()})
    # Ordinary words that differ from a term by the allowed edits; bounded by the sample's words near max_terms terms.
    usual = counts.where(~F.col("w").endswith(STEM) & (F.col("b") >= min_docs) & (F.col("b") * n1 > F.col("a") * n0))
    alike = usual.select("w").mapInPandas(near_terms(lexicon), "w string")
    model = Model(lexicon, [], frozenset(r["w"] for r in alike.collect()))
    got = apply_features(sample, model, "_y", "_text").toPandas()
    x = np.array(got["features"].tolist(), dtype=float).reshape(len(got), Model.FEATURES)
    model.weights = logistic(x, got["_y"].to_numpy(dtype=float))
    return model


def without_covered(found: dict[str, float], slack: float = 1.0) -> dict[str, float]:
    """Leave out words and stems that a shorter stem, no less telling by more than ``slack``, stands
    for, and stems that tell less than a word that they stand for."""
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t.rstrip(STEM)), t)):
        plain, odds = term.rstrip(STEM), found[term]
        if any(plain.startswith(k[:-1]) and kept[k] >= odds - slack for k in kept if k.endswith(STEM)):
            continue
        if term.endswith(STEM) and any(
            not o.endswith(STEM) and o.startswith(plain) and found[o] >= odds - 0.05 for o in found
        ):
            continue
        kept[term] = odds
    return kept


def near_terms(lexicon: dict[str, float]):
    """A map over batches that keeps the words that hit a term without being one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(lexicon, [])
        for batch in batches:
            found = [w for w in batch["w"] if w not in lexicon and own.lookup(w)]
            yield pd.DataFrame({"w": pd.Series(found, dtype=object)})

    return run


def apply_features(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    lexicon, weights, ordinary = model.lexicon, model.weights, model.ordinary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memo("")
        own = Model(lexicon, weights, ordinary)
        for batch in batches:
            rows = [own.features(t) for t in batch[text]]
            scores = own.score(np.array(rows, dtype=float).reshape(len(rows), Model.FEATURES))
            yield pd.DataFrame({key: batch[key], "features": rows, "score": scores})

    schema = f"`{key}` {dict(df.dtypes)[key]}, features array<double>, score double"
    return df.select(key, text).mapInPandas(run, schema)


def scored_rows(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their score, whatever their columns."""
    lexicon, weights, ordinary = model.lexicon, model.weights, model.ordinary

    @F.pandas_udf("double")
    def scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_memo("")
        own = Model(lexicon, weights, ordinary)
        for batch in batches:
            rows = [own.features(t) for t in batch]
            yield pd.Series(own.score(np.array(rows, dtype=float).reshape(len(rows), Model.FEATURES)))

    return docs.withColumn("score", scorer(F.col(text)))


def score(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3
) -> DataFrame:
    """Per document: key, held_out, score, predicted."""
    scored = apply_features(docs, model, key, text)
    return scored.select(
        key,
        is_held_out(F.col(key)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
