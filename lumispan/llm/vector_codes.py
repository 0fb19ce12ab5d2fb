"""Product codes of vectors: integer codebooks by rounds of assignment, with a VA-file in front of every search.

Components become integers floor(scale * x). A vector is cut into equal consecutive parts, and each part position has a
codebook that starts as the parts of the vectors with the smallest ids. A round assigns every part to its nearest entry
and replaces each entry by the floor of the mean of its parts.

The search for the nearest entry filters by a vector-approximation file: the coordinates of the entries are quantised to
a few bits, cells between quantiles of each coordinate. For a part, one table per coordinate gives the least and the
greatest squared distance to each cell; their sums over an entry's cells bound its distance from below and above. Only
entries whose lower bound doesn't exceed the least upper bound are refined, by exact integer distances, ties to the
lower index, so assignments are those of a full search.

What Spark moves is small: a task sums the parts it assigned to an entry before anything is shuffled, and a round
returns a row per part, entry and coordinate. The codebooks (at most parts * entries * width integers, whatever the
number of vectors) are the only thing the driver reads, and what every task gets.

Edge cases: a null vector, and one with a null or non-finite component, is dropped; the dimension is the one that most
of the remaining vectors have (ties to the smaller), and vectors of other dimensions, or all where it can't be cut into
equal parts, have a null code and error and don't train; a scaled component beyond 2**27 is held there, so that
distances fit into 64 bits; fewer vectors than entries give codebooks of as many entries as there are vectors; ids may
repeat or be null (last), rows of one id are ordered by their components; an empty table gives no rows; null labels are
one label; a label's error sum beyond 64 bits is null; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, PARTS, ENTRIES, ROUNDS, BITS = 1024, 4, 256, 4, 4
LIMIT = 2**27


class Approximation:
    """The entries of one codebook as a vector-approximation file of ``bits`` bits a coordinate."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, width = entries.shape
        cells = min(2**bits, n)
        order = np.sort(entries, axis=0)
        starts = order[(np.arange(cells) * n) // cells]
        self.low = np.empty((width, cells), dtype=np.int64)
        self.high = np.empty((width, cells), dtype=np.int64)
        self.cell = np.empty((width, n), dtype=np.int64)
        for d in range(width):
            cell = np.searchsorted(starts[:, d], entries[:, d], side="right") - 1
            self.cell[d] = cell
            # a cell that holds no entry keeps its start: no entry looks it up
            self.low[d] = self.high[d] = starts[:, d]
            np.minimum.at(self.low[d], cell, entries[:, d])
            np.maximum.at(self.high[d], cell, entries[:, d])

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per part and entry: bounds of the squared distance, summed from tables by coordinate and cell."""
        lower = np.zeros((len(parts), len(self.entries)), dtype=np.int64)
        upper = np.zeros_like(lower)
        for d in range(parts.shape[1]):
            x = parts[:, d, None]
            to_low, to_high = self.low[d] - x, x - self.high[d]
            outside = np.maximum(np.maximum(to_low, to_high), 0)
            far = np.maximum(np.abs(to_low), np.abs(to_high))
            lower += np.take(outside * outside, self.cell[d], axis=1)
            upper += np.take(far * far, self.cell[d], axis=1)
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per part: the index of its nearest entry, ties to the lower, and its exact squared distance."""
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        gap = parts[row] - self.entries[entry]
        exact = np.einsum("ij,ij->i", gap, gap)
        # rows come in order; within a row the least distance, then the lower entry, goes first
        order = np.lexsort((entry, exact, row))
        first = order[np.searchsorted(row[order], np.arange(len(parts)))]
        return entry[first], exact[first]


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and vector (integers) of the rows whose components are all there and finite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    held = lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int")
    return vectors.where(x.isNotNull() & finite).select("vec_id", "label", F.transform(x, held).alias("vector"))


def _stacked(column: pd.Series, width: int) -> np.ndarray:
    if not len(column):
        return np.empty((0, width), dtype=np.int64)
    return np.stack(column.to_list()).astype(np.int64)


def _chunks(batches: Iterator[pd.DataFrame], size: int = 2000) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), size):
            yield batch.iloc[k : k + size]


def refit(rows: DataFrame, books: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One round: every part to its nearest entry, every entry to the floor of the mean of its parts."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = [Approximation(b, bits) for b in books]
        total = np.zeros((parts, entries, width), dtype=np.int64)
        count = np.zeros((parts, entries), dtype=np.int64)
        for batch in _chunks(batches):
            x = _stacked(batch["vector"], parts * width).reshape(-1, parts, width)
            for p in range(parts):
                code, _ = files[p].nearest(x[:, p])
                np.add.at(total[p], code, x[:, p])
                np.add.at(count[p], code, 1)
        part, entry = np.nonzero(count)
        if len(part):
            yield pd.DataFrame({"part": part, "entry": entry, "n": count[part, entry], "total": list(total[part, entry])})

    found = rows.select("vector").mapInPandas(sums, "part int, entry int, n bigint, total array<bigint>")
    each = [F.sum(F.col("total")[d]).alias(f"s{d}") for d in range(width)]
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
        out[r["part"], r["entry"]] = [r[f"s{d}"] // r["n"] for d in range(width)]
    return out


def codebooks(rows: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS) -> np.ndarray:
    """Integer codebooks (part, entry, coordinate) of the rows, which all have vectors of ``dimension`` integers."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    start = np.array([r["vector"] for r in first], dtype=np.int64).reshape(len(first), parts, dimension // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds):
        books = refit(rows, books, bits)
    return books


def coded(rows: DataFrame, books: np.ndarray, bits: int = BITS) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances to the entries, summed over parts)."""
    parts, _, width = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = [Approximation(b, bits) for b in books]
        for batch in _chunks(batches):
            x = _stacked(batch["vector"], parts * width).reshape(-1, parts, width)
            code = np.empty((len(x), parts), dtype=np.uint8)
            error = np.zeros(len(x), dtype=np.int64)
            for p in range(parts):
                code[:, p], away = files[p].nearest(x[:, p])
                error += away
            yield batch[["vec_id", "label"]].assign(code=[bytes(c).hex() for c in code], error=error)

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "vector").mapInPandas(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every usable vector, and the codebooks. ``entries`` is 256 at most."""
    rows = written(usable(vectors), "vectors", batch=4000)
    sizes = rows.groupBy(F.size("vector").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), "size").limit(1).collect()
    dimension = most[0]["size"] if most else 0
    nothing = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if dimension == 0 or dimension % parts:
        return nothing, np.empty((parts, 0, 0), dtype=np.int64)
    fit = F.size("vector") == dimension
    books = codebooks(rows.where(fit), dimension, parts, entries, rounds, bits)
    return coded(rows.where(fit), books, bits).unionByName(nothing.where(F.size(rows["vector"]) != dimension)), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels), codebooks_sha256."""
    rows, books = compressed(vectors)
    rows = written(rows, "codes", batch=4000)
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint")
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256")
    )
