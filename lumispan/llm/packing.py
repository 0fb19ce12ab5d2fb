"""Best-fit packing of token sequences by a configuration linear program.

1. Pieces: each document's ids and an end id; only documents longer than a sequence are cut.
2. Histogram: pieces by length, at most one row per length, whatever the corpus holds.
3. Program: a configuration is a multiset of lengths that fits a sequence; wanted are the fewest
   configurations, counted fractionally, that cover the histogram. Multiplicative weights work on it:
   every length has a price, multiplied up or down by how far it lags in coverage; one knapsack dynamic
   program over the prices gives, for every length at once, the best configuration that holds it.
   Any prices, divided by the best value of a configuration, bound the number of sequences from below:
   a first run of rounds raises that bound, a second builds a cover from its prices. Neither is driven to
   the program's exact value; how far packing and bound are apart is known at the end.
4. Rounding: the whole copies of configurations that fill a sequence, or nearly, are taken; what is left
   is placed best-fit in order of decreasing length, still on the histogram. All whole copies, or a
   share of them down to none, are tried, so rounding never costs more than best fit would.
5. Assignment: the i-th piece of a length takes the i-th place that the configurations have for it.

Only the histogram and the configurations (bounded by the sequence length) meet the driver. Pieces
get their rank within a length by ``running_total``, so a length that a third of all pieces share is cut
by hash. Edge cases: null or empty text is the end id alone; repeated rows are packed once each; pieces
of equal length may trade places between them but every rerun gives the same result; an empty
table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, spread, worker_memo, written

Config = tuple[tuple[int, int], ...]  # (length, count), longest first
#: Runs that a worker remembers: some 200 bytes each.
MEMO = 800_000
RANK_BUCKETS = 256


class RunEncoder:
    """The ids of texts as little-endian 32-bit bytes, put together from the ids of their runs.

    White space is never part of a token of this tokenizer, and neither are letters or digits beside what
    isn't one, so a text is encoded run by run, and a run without the points and commas that end it.
    Runs are split at blanks and line ends only; whatever else they hold is the tokenizer's
    business. A run of small Latin letters is one word to the tokenizer, whose steps before the merges leave it as it
    is, so it goes to the merges at once. Other new runs of a text are encoded together and told apart by their offsets.
    """

    def __init__(self, tokenizer: str, end_id: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.model = self.tokenizer.model
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.memo: dict[str, bytes] = worker_memo(f"ids {tokenizer}")
        self.memo[""] = b""
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # How the tokenizer spells the bytes of letters up to U+017F.
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {c: spell(chr(c))[0][0] for c in range(128, 0x180) if chr(c).isalpha()}

    def encode(self, runs: list[str]) -> None:
        merged, other = self.model.tokenize, []
        for r in runs:
            if r.isalpha() and r.islower():
                word = r
                if not r.isascii():
                    if max(r) >= "\u0180" or r != r.lower() or not unicodedata.is_normalized("NFC", r):
                        other.append(r)
                        continue
                    word = r.translate(self.spelled)
                ids = [x.id for x in merged(word)]
                self.memo[r] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                other.append(r)
        if other:
            self.encode_whole(other)

    def encode_whole(self, runs: list[str]) -> None:
        if any(s in r for s in self.special for r in runs):
            found = [e.ids for e in self.tokenizer.encode_batch(runs, add_special_tokens=False)]
            self.memo.update((r, np.array(x, dtype="<u4").tobytes()) for r, x in zip(runs, found, strict=True))
            return
        e = self.tokenizer.encode(" ".join(runs), add_special_tokens=False)
        data = np.array(e.ids, dtype="<u4").tobytes()
        starts = [a for a, _ in e.offsets]
        at, k = 0, 0
        for r in runs:
            at += len(r) + 1
            z = bisect_left(starts, at, k)
            self.memo[r] = data[4 * k : 4 * z]
            k = z

    def __call__(self, text: str) -> bytes:
        runs = text.replace("\n", " ").split(" ")
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, runs)) + self.end
        except KeyError:
            pass
        new = [r for r in set(runs) if r not in memo]
        if len(memo) + 2 * len(new) > MEMO:
            memo.clear()
            memo[""] = b""
            new = list(set(runs))
        cores = {}
        for r in new:
            core = r.rstrip(".,")
            core = core if core and core[-1].lower()[-1].isalnum() else r
            # Special tokens are told by their case, so nothing that could become one is lowered.
            cores[r] = (core.lower() if core.isascii() and "<|" not in core else core), r[len(core) :]
        wanted = {x for pair in cores.values() for x in pair if x not in memo}
        if wanted:
            self.encode(list(wanted))
        for r, (core, rest) in cores.items():
            if rest or core is not r:
                memo[r] = memo[core] + memo[rest] if rest else memo[core]
        return b"".join(map(memo.__getitem__, runs)) + self.end


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, key: str = "doc_id", text: str = "text", end_id: int = 0
) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = RunEncoder(tokenizer, end_id)
        step = 4 * capacity
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, body in enumerate(batch[text]):
                ids = ids_of(body or "")
                for at in range(0, len(ids), step):
                    part = ids if len(ids) <= step else ids[at : at + step]
                    row.append(k)
                    piece.append(at // step)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            keys = batch[key].take(row).reset_index(drop=True)
            yield pd.DataFrame({key: keys, "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(key, text).mapInPandas(run, schema)


def best_fill(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for every capacity, and the item that it ends with (-1: none)."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c], last[c] = value[c - 1], -2  # -2: one place stays empty
        if k := upto[c]:
            got = value[c - lengths[:k]] + prices[:k]
            j = int(got.argmax())
            if got[j] > value[c]:
                value[c], last[c] = got[j], j
    return value, last


def filled(last: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0 and last[room] != -1:
        if last[room] == -2:
            room -= 1
        else:
            out.append(int(last[room]))
            room -= int(lengths[last[room]])
    return out


def feasible_prices(lengths: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Prices to begin with: lengths themselves; for k to 11 what counts how many pieces of a kind can sit k to a sequence;
    and what rounds long pieces up to a whole sequence and short ones down to nothing."""
    x = lengths / capacity
    out = [x]
    for k in range(1, 12):
        y = (k + 1) * x
        out.append(np.where(np.abs(y - np.round(y)) < 1e-12, x, np.floor(y) / k))
    short = lengths[lengths <= capacity // 2]
    for least in short[:: max(1, len(short) // 8)]:
        out.append(np.where(lengths > capacity - least, 1.0, np.where(lengths < least, 0.0, x)))
    return [p for p in out if p.max() > 0]


def ascended(
    counts: dict[int, int], capacity: int, incumbent: float, rounds: int = 120, rate: float = 0.3, near: float = 0.02, gap: float = 0.002
) -> tuple[float, np.ndarray]:
    """A lower bound on the number of sequences, and the prices that prove it, scaled so that no configuration is worth
    more than 1. In every round one knapsack dynamic program gives the value of the best configuration, and of the best
    that holds each length; prices are multiplied up where a length is in none of the best, or is used less than its
    pieces need, and down where it is used more. Ends after ``rounds``, or when no packing can have fewer sequences than
    ``incumbent`` by more than a share ``gap``.
    """
    lengths = np.array(sorted(counts))
    n = np.array([counts[x] for x in lengths], dtype=float)
    best, prices = 0.0, lengths / capacity
    for p in feasible_prices(lengths, capacity):
        value, _ = best_fill(lengths, p, capacity)
        if (bound := float(n @ p) / value[capacity]) > best:
            best, prices = bound, p / value[capacity]
    p = np.maximum(prices, 1e-6)
    for t in range(rounds):
        if np.ceil(best - 1e-6) >= (1 - gap) * incumbent and t >= 8:
            break
        value, last = best_fill(lengths, p, capacity)
        bound = float(n @ p) / value[capacity]
        p = p / value[capacity]
        if bound > best:
            best, prices = bound, p.copy()
        worth = p + value[capacity - lengths] / value[capacity]
        use, total = np.zeros(len(lengths)), 0.0
        for j in np.flatnonzero(worth >= 1 - near):
            weight = np.exp((worth[j] - 1) / (near / 4)) * n[j] * p[j]
            for i in (int(j), *filled(last, lengths, int(capacity - lengths[j]))):
                use[i] += weight
            total += weight
        lag = 1 - bound * use / (total * n)  # of what each length needs, the share that is missing
        p = p * np.exp(rate / (1 + t / 10) * (0.2 * np.clip(lag, -1, 1) + np.clip(1 - worth, 0, 1)))
    return best, prices


def fractional(
    counts: dict[int, int], capacity: int, incumbent: float = np.inf, rounds: int = 120, rate: float = 6.0, slack: float = 0.03
) -> tuple[dict[Config, float], float]:
    """A fractional cover, as configurations and how often each is used, and a lower bound on the number of sequences: the
    best that the prices of a round prove. The cover starts from the prices of that bound and raises those of lengths
    that lag behind; what is left when no configuration can be added is not covered."""
    lengths = np.array(sorted(counts))
    n = np.array([counts[x] for x in lengths], dtype=float)
    left = n.copy()
    used: dict[Config, float] = {}
    dual, base = ascended(counts, capacity, incumbent)
    base = np.maximum(base, 1e-9)
    for _ in range(rounds):
        live = left > 1e-9 * n
        if not live.any() or (left @ lengths) < 1e-3 * (n @ lengths):
            break
        share = np.where(live, left / n, 0)
        lag = share - share[live].mean()
        prices = np.where(live, base * np.exp(rate * np.clip(lag, -1, 1) / 10), 0)
        value, last = best_fill(lengths, prices, capacity)
        dual = max(dual, float(n @ prices) / value[capacity])
        order = np.argsort(-share * lengths)
        bound = (1 - slack) * value[capacity]
        added = False
        for widen in (1.0, 0.0):  # near-optimal ones; if none can be added, the best for each length
            for j in order:
                if left[j] <= 1e-9 * n[j] or prices[j] + value[capacity - lengths[j]] < widen * bound:
                    continue
                items = [int(j), *filled(last, lengths, int(capacity - lengths[j]))]
                held: dict[int, int] = {}
                for i in items:
                    held[i] = held.get(i, 0) + 1
                amount = min(left[i] / c for i, c in held.items())
                first = left[j] / held[int(j)]
                amount = min(amount, max(0.25 * first, 0.02 * n[j]))
                if amount <= 1e-9:
                    continue
                for i, c in held.items():
                    left[i] -= amount * c
                name = tuple(sorted(((int(lengths[i]), c) for i, c in held.items()), reverse=True))
                used[name] = used.get(name, 0.0) + amount
                added = True
            if added:
                break
        if not added:
            break
    return used, dual


def rounded(used: dict[Config, float], counts: dict[int, int], capacity: int, waste: float = 0.0) -> list[tuple[Config, int]]:
    """Whole configurations: the whole copies of fractional ones that leave at most a share ``waste`` of a sequence empty,
    fullest first, and best fit for the rest."""
    left = dict(counts)
    out: dict[Config, int] = {}
    for config, amount in sorted(used.items(), key=lambda x: (-sum(a * b for a, b in x[0]), -x[1], x[0])):
        if sum(a * c for a, c in config) < capacity * (1 - waste):
            break
        times = min([int(amount), *(left[a] // c for a, c in config)])
        if times > 0:
            out[config] = out.get(config, 0) + times
            for a, c in config:
                left[a] -= times * c
    # Best fit decreasing on the histogram: equal pieces that go the same way go together.
    open_rooms: dict[int, dict[Config, int]] = {}
    rooms: list[int] = []

    def put(room: int, config: Config, times: int) -> None:
        if room not in open_rooms:
            open_rooms[room] = {}
            insort(rooms, room)
        open_rooms[room][config] = open_rooms[room].get(config, 0) + times

    for a in sorted((x for x in left if left[x] > 0), reverse=True):
        rest = left[a]
        while rest > 0:
            at = bisect_left(rooms, a)
            if at == len(rooms):
                each = capacity // a
                if rest >= each:
                    put(capacity - each * a, ((a, each),), rest // each)
                    rest %= each
                if rest:
                    put(capacity - rest * a, ((a, rest),), 1)
                break
            room = rooms[at]
            config, times = next(iter(open_rooms[room].items()))
            each = min(room // a, rest)
            moved = min(times, rest // each)
            open_rooms[room][config] -= moved
            if not open_rooms[room][config]:
                del open_rooms[room][config]
            if not open_rooms[room]:
                del open_rooms[room]
                rooms.pop(at)
            put(room - each * a, (*config, (a, each)), moved)
            rest -= moved * each
    for configs in open_rooms.values():
        for config, times in configs.items():
            out[config] = out.get(config, 0) + times
    return sorted(out.items())


def solve(counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """The best of some roundings: whole copies of the full or of nearly full configurations, all of them or a share, or best
    fit alone."""
    if not counts:
        return []
    best = rounded({}, counts, capacity)
    least = sum(times for _, times in best)
    used, dual = fractional(counts, capacity, least)
    for waste in (0.0, 0.005, 0.02, 0.05, 1.0):
        for share in (1.0, 0.75, 0.5, 0.25):
            if least <= np.ceil(dual - 1e-6):
                return best  # no packing has fewer
            found = rounded({c: share * x for c, x in used.items()}, counts, capacity, waste)
            size = sum(times for _, times in found)
            if size < least:
                best, least = found, size
    return best


def places(configs: list[tuple[Config, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end rank, first sequence, pieces of that
    length in a sequence, offset of the first of them)."""
    out, ranks, sequence = [], {}, 0
    for config, times in configs:
        at = 0
        for a, c in config:
            lo = ranks.get(a, 0)
            out.append((a, lo, lo + times * c, sequence, c, at))
            ranks[a] = lo + times * c
            at += a * c
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces that have key, piece and length."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = places(solve(counts, capacity))
    slots = spark.createDataFrame(
        rows or [(0, 0, 0, 0, 1, 0)],
        "_length bigint, _lo bigint, _hi bigint, _sequence bigint, _each bigint, _at bigint",
    )
    ranked = running_total(
        pieces.withColumn("_bucket", spread(F.col(key), RANK_BUCKETS)),
        ["length"],
        "_bucket",
        [key, "piece", "ids_crc32"],
        F.lit(1),
        "_rank",
    )
    # Places follow from the capacity: configurations of at most 2048 lengths, six numbers each.
    found = ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")),
    )
    within = F.col("_rank") - F.col("_lo")
    return (
        found.withColumn("sequence_id", (F.col("_sequence") + F.floor(within / F.col("_each"))).cast("bigint"))
        .withColumn("offset", (F.col("_at") + F.pmod(within, F.col("_each")) * F.col("length")).cast("bigint"))
        .drop("_bucket", "_rank", "_length", "_lo", "_hi", "_sequence", "_each", "_at")
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(cut_pieces(docs, tokenizer, capacity, key, text), "pieces"), capacity, key)
