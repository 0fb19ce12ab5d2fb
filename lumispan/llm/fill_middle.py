"""Fill-in-the-middle rewriting of documents, by a sparse scan for events.

A unit is a run of white space with the word after it, or the white space at the end of a text. One Aho-Corasick
automaton over a text reports the characters that can change the class (the six ASCII blanks) and the sentinels, and
nothing else: a gap between neighbouring blanks that isn't empty is one whole word, so units are counted and the end of
the k-th is looked up from the places of blanks alone. Python sees a text once and returns three numbers; cuts are made,
sentinels set and texts rebuilt by Spark's own string functions.

Edge cases: a null text counts as empty; an empty text, and one that holds a sentinel, stays as it is (plain); texts of
any length are scanned whole and only their blanks are remembered; a null id is drawn for as an empty string; repeated
rows with one id are cut alike and kept apart; an empty table gives no rows; there are no ties, since every cut is a
draw from the id; extra columns are dropped by ``fill_in_middle``, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED = 42
#: Of a hundred documents, so many are rewritten, and so many of those suffix first.
REWRITTEN, SUFFIX_FIRST = 50, 80

CUTS = "n bigint, first bigint, second bigint, sentinel boolean"


def event_scanner(sentinels: tuple[str, ...] = SENTINELS):
    """The automaton: blanks carry 0, sentinels 1."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for blank in SPACES:
        automaton.add_word(blank, 0)
    for sentinel in sentinels:
        automaton.add_word(sentinel, 1)
    automaton.make_automaton()
    return automaton


def unit_ends(automaton, text: str) -> tuple[np.ndarray, bool]:
    """Where each unit ends, and whether a sentinel was met, from the events of one scan."""
    blanks, sentinel = [], False
    for at, kind in automaton.iter(text):
        if kind:
            sentinel = True
        else:
            blanks.append(at)
    edges = np.empty(len(blanks) + 2, dtype=np.int64)
    edges[0], edges[-1] = -1, len(text)
    edges[1:-1] = blanks
    ends = edges[1:][np.diff(edges) > 1]
    if blanks and blanks[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, sentinel


def _cuts(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    automaton = event_scanner()
    rows = []
    for t, a, b in zip(text, first, second):
        ends, sentinel = unit_ends(automaton, t)
        n = len(ends)
        low, high = sorted((int(a) % (n + 1), int(b) % (n + 1)))
        rows.append((n, int(ends[low - 1]) if low else 0, int(ends[high - 1]) if high else 0, sentinel))
    return pd.DataFrame(rows, columns=["n", "first", "second", "sentinel"])


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rewritten: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    psm is prefix, suffix, middle; spm is suffix, prefix, middle, each after its sentinel but the prefix of psm, which
    has its sentinel too. Draws come from the sha256 of ``seed`` and the id.
    """
    cuts = F.pandas_udf(_cuts, CUTS)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.withColumns({f"h{k}": _draw(F.col("digest"), k) for k in (1, 2, 3, 4)}).drop("digest")
    rows = rows.withColumn("cut", cuts("text", "h1", "h2"))
    plain = (F.col("text") == "") | F.col("cut.sentinel") | (F.col("h3") % 100 >= rewritten)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "first": F.col("cut.first").cast("int"), "second": F.col("cut.second").cast("int")})
    prefix = F.substring("text", F.lit(1), F.col("first"))
    middle = F.substring("text", F.col("first") + 1, F.col("second") - F.col("first"))
    suffix = F.substring("text", F.col("second") + 1, F.length("text"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id", F.col("cut.n").alias("n"), "form",
        F.when(cut, F.col("cut.first")).alias("prefix_chars"),
        F.when(cut, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from, by its form and its sentinels alone. A rewritten text holds none of its
    own, and none can arise where parts meet, so the first of each kind is the one that was set."""
    n = len(PREFIX)
    to = lambda mark: F.instr(output, mark)
    piece = lambda start, end: F.substring(output, start, end - start)
    rest = lambda start: F.substring(output, start, F.length(output))
    one = F.lit(n + 1)
    psm = F.concat(piece(one, to(SUFFIX)), rest(to(MIDDLE) + n), piece(to(SUFFIX) + n, to(MIDDLE)))
    spm = F.concat(piece(to(PREFIX) + n, to(MIDDLE)), rest(to(MIDDLE) + n), piece(one, to(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with the sha256 of the output and of the text rebuilt from it instead of the output."""
    rows = fill_in_middle(docs)
    rows = rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
    return written(rows, "fill-middle", batch=200)
