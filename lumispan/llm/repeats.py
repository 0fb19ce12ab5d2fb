"""Repeated byte strings by a sparse, distributed enhanced suffix array.

The strings wanted are ``length`` (200) bytes long. Anchors make the suffix array sparse: in every
stretch of 137 consecutive 64-byte grams the one of least hash (the leftmost of equal ones) is an
anchor, so each 200-byte string holds an anchor, at the same place in all its occurrences.

1. Anchors whose gram stands at one place only (one text, one position, however many copies the text
   has) end here, by a grouped least and most. Around the others the text is cut out: up to 136
   bytes before, 200 bytes from the anchor on. A task joins equal cut-outs into one row with their places.
2. Suffixes that begin with the same gram lie together in a suffix array, so each gram's group is
   sorted by itself. Its longest-common-prefix array is scanned with a stack, which yields the
   common-prefix intervals (r bytes to the right in common). Within an interval the members are sorted
   by what stands before them; where they differ to the left (left-extension diversity) they fall
   into classes with l bytes to the left in common. Classes with l + r >= 200 are maximal repeats, and
   all their occurrences are output.
3. Grams with more than ``MAX_GROUP`` occurrences are spread by their cut-outs, equal ones are counted, and what is
   still a large group is split before it is sorted, without loss: a 200-byte string that reaches l bytes to the
   left of its anchor has l in some half of 0..136, and all strings of a half share a longer core than
   the gram, by which they are regrouped, half by half until groups are small or the core is the string itself.
4. Spans of a text are merged and cut out; of a text with copies every byte is repeated.

Texts and cores are named by 128-bit hashes. Texts meet their anchors by a 64-bit hash; should two texts share one,
each is cut at the anchors of both, which costs time only, as what is compared is read from the text itself.

Edge cases: null text counts as empty; texts under 200 bytes have no such string and stay whole;
overlapping occurrences count; texts that repeat one byte or a short period are one group of equal
cut-outs; repeated rows and ids are copies; very long texts are
read in overlapping parts; of grams with equal hashes the leftmost is the anchor; an empty table gives no rows; extra columns are
dropped or kept as the caller asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_memo, written

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM  # bytes that a string can have before its anchor
MAX_GROUP = 8000
#: Distinct cut-outs, and places of them, that a task holds before it hands them on.
HELD, PLACES_HELD = 20_000, 200_000

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, size=256, dtype=_U)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes that one pass over a text holds; longer texts are taken in overlapping parts.
PART = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=_U)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * _U(pow(base, done, 2**64))
            done += more
    return out


class Anchors:
    """Anchors of byte strings; powers are kept for the longest part seen."""

    def __init__(self, gram: int = GRAM, length: int = LENGTH) -> None:
        self.gram, self.window = gram, length - gram + 1
        self.up, self.down = _powers(_BASE, 4096), _powers(_INVERSE, 4096)

    def gram_hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.up):
            size = 1 << int(n).bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=_U)
            np.cumsum(_BYTE[data] * self.down[:n], out=sums[1:])
            h = (sums[self.gram :] - sums[: -self.gram]) * self.up[: n - self.gram + 1]
            h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
            return h ^ (h >> _U(29))

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Gram hashes and positions of the anchors."""
        hashes, places = [], []
        step = PART - 2 * LENGTH
        for at in range(0, max(1, len(data)), step):
            h, p = self._part(np.frombuffer(data, dtype=np.uint8)[at : at + PART])
            hashes.append(h)
            places.append(p + at)
            if at + PART >= len(data):
                break
        if len(hashes) == 1:
            return hashes[0], places[0]
        place, first = np.unique(np.concatenate(places), return_index=True)
        return np.concatenate(hashes)[first], place

    def _part(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.window
        if len(data) < self.gram + w - 1:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        h = self.gram_hashes(data)
        n = len(h)
        # The hash's upper bits, then the place: the least value is the leftmost of the least hashes.
        value = (h & ~_U(PART - 1)) | np.arange(n, dtype=_U)
        blocks = -(-n // w)
        padded = np.full(blocks * w, np.iinfo(_U).max, dtype=_U)
        padded[:n] = value
        grid = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
        chosen = least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))]
        place = np.unique((chosen & _U(PART - 1)).astype(np.int64))
        return h[place].view(np.int64), place


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchored(texts: DataFrame) -> DataFrame:
    """From node, name and text: gram, node, pos. A task takes a copied text once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memo("")  # what another operator remembered in this worker goes
        find, seen = Anchors(), set()
        for batch in batches:
            first = []
            for name in batch["name"]:
                first.append(name not in seen)
                seen.add(name)
            batch = batch[first]
            found = [find.of(bytes_of(t)) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"].to_numpy(), "gram": [f[0] for f in found], "pos": [f[1] for f in found]})

    rows = texts.select("node", "name", "text").mapInPandas(run, "node bigint, gram array<bigint>, pos array<bigint>")
    rows = rows.select("node", F.explode(F.arrays_zip("gram", "pos")).alias("x"))
    return rows.select(F.col("x.gram").alias("gram"), "node", F.col("x.pos").cast("int").alias("pos"))


CUT = "gram bigint, ctx binary, hot boolean, before binary, after binary, places binary"
#: Bytes of a place: the text's name and, most significant byte first, the position.
PLACE = 20


def cut_outs(texts: DataFrame) -> DataFrame:
    """From name, text and the marks in it (pos, gram, hot): gram, ctx (hash of the cut-out), hot, before (reversed), after,
    places. Equal cut-outs that a task meets are one row, as far as it can hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        worker_memo("")
        seen: set[bytes] = set()
        held: dict[tuple[int, bytes], tuple[bool, bytes, bytes, list[bytes]]] = {}
        n = 0

        def frame() -> pd.DataFrame:
            rows = [(g, c, h, b, a, b"".join(p)) for (g, c), (h, b, a, p) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["gram", "ctx", "hot", "before", "after", "places"])

        for batch in batches:
            for name, text, pos, gram, hot in zip(batch["name"], batch["text"], batch["pos"], batch["gram"], batch["hot"], strict=True):
                if name in seen:
                    continue
                seen.add(name)
                data = bytes_of(text)
                for p, g, h in zip(pos.tolist(), gram.tolist(), hot.tolist(), strict=True):
                    before, after = data[max(0, p - REACH) : p][::-1], data[p : p + LENGTH]
                    ctx = xxhash.xxh3_128_digest(bytes([len(before)]) + before + after)
                    if (g, ctx) not in held:
                        held[g, ctx] = h, before, after, []
                    held[g, ctx][3].append(name + p.to_bytes(4, "big"))
                n += len(pos)
                if len(held) > HELD or n > PLACES_HELD:
                    yield frame()
                    n = 0
        yield frame()

    return texts.select("name", "text", "pos", "gram", "hot").mapInPandas(run, CUT)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals of a sorted group, by a stack scan: (first, last, common length).
    lcp[i] is what entries i - 1 and i have in common; lcp[0] is ignored."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        start = i - 1
        while stack and stack[-1][1] > now:
            start, common = stack.pop()
            yield start, i - 1, common
        if now >= 0 and (not stack or stack[-1][1] < now):
            stack.append((start, now))


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # the first difference is in lo..hi
    while lo < hi:
        mid = (lo + hi) // 2
        if a[lo : mid + 1] == b[lo : mid + 1]:
            lo = mid + 1
        else:
            hi = mid
    return lo


def maximal_repeats(
    before: list[bytes], after: list[bytes], length: int = LENGTH
) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of one gram's group: (bytes to the left, bytes to the right, members).

    Members are suffixes by number; ``before`` is what stands to the left, nearest byte first.
    """
    n = len(after)
    order = sorted(range(n), key=after.__getitem__)
    lcp = [0] + [common(after[a], after[b]) for a, b in zip(order, order[1:], strict=False)]
    rank = {m: i for i, m in enumerate(sorted(range(n), key=before.__getitem__))}
    for first, last, right in intervals(lcp):
        if right + REACH < length:
            continue
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        left = [0] + [common(before[a], before[b]) for a, b in zip(members, members[1:], strict=False)]
        if max(left) + right < length:
            continue
        for a, z, shared in intervals(left):  # each class is diverse to the left of what it shares
            if shared + right >= length:
                yield shared, right, members[a : z + 1]


def covered(before: list[bytes], after: list[bytes], count: list[int], lo: int, hi: int) -> list[list[int]]:
    """Per member: what its repeats cover, [from, to) around the anchor, or nothing. Only strings that
    reach lo to hi bytes to the left are judged here. All of them hold the anchor's gram, so what they
    cover together is one run, and its two ends are all that is kept of a member's repeats."""
    first, end = [1] * len(after), [0] * len(after)

    def add(member: int, left: int, right: int) -> None:
        most, least = min(left, hi), max(LENGTH - right, lo)
        if least <= most:
            first[member] = min(first[member], -most)
            end[member] = max(end[member], LENGTH - least)

    for i, c in enumerate(count):
        if c > 1:
            add(i, len(before[i]), len(after[i]))
    if len(after) == 2:
        right = common(after[0], after[1])
        if right + REACH >= LENGTH and (left := common(before[0], before[1])) + right >= LENGTH:
            add(0, left, right)
            add(1, left, right)
    elif len(after) > 2:
        for left, right, members in maximal_repeats(before, after):
            for m in members:
                add(m, left, right)
    return [[a, z] if a <= 0 else [] for a, z in zip(first, end, strict=True)]


def scanned_places(cut: DataFrame) -> DataFrame:
    """Rows of cut_outs by gram: those that aren't hot are scanned, and what repeats cover comes out as places, first, end
    (from and to, seen from each place); hot ones come out as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in SCANNED.split(", ")]
        held: list[tuple] = []

        def settle() -> list[tuple]:
            members: dict[bytes, tuple[bytes, bytes, set[bytes]]] = {}
            for _, ctx, _, before, after, places in held:
                own = members.setdefault(ctx, (before, after, set()))[2]
                own.update(places[i : i + PLACE] for i in range(0, len(places), PLACE))
            found = list(members.values())
            if len(found) == 1 and len(found[0][2]) < 2:
                return []
            covers = covered([f[0] for f in found], [f[1] for f in found], [len(f[2]) for f in found], 0, REACH)
            return [(b"".join(places), *cover, False, 0, b"", b"", b"") for (_, _, places), cover in zip(found, covers, strict=True) if cover]

        for batch in batches:
            rows: list[tuple] = []
            for r in batch.itertuples(index=False, name=None):
                if r[2]:
                    rows.append((r[5], 0, 0, True, r[0], r[1], r[3], r[4]))
                    continue
                if held and r[0] != held[0][0]:
                    rows += settle()
                    held = []
                held.append(r)
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(settle(), columns=columns)

    # Hot grams are dealt by their cut-outs, the others whole.
    salt = F.when(F.col("hot"), F.xxhash64("ctx")).otherwise(F.lit(0))
    return cut.repartition("gram", salt).sortWithinPartitions("gram").mapInPandas(run, SCANNED)


SCANNED = "places binary, first int, end int, hot boolean, gram bigint, ctx binary, before binary, after binary"


def listed(places: Column) -> Column:
    """The places of a row, one by one."""
    return F.transform(F.sequence(F.lit(0), (F.length(places) / PLACE - 1).cast("int")), lambda i: F.substring(places, i * PLACE + 1, PLACE))


def scanned(groups: DataFrame) -> DataFrame:
    """From core, lo, hi, gram, ctx, before, after, n, partitioned by (core, lo) and sorted by it: gram, ctx,
    cover. A task holds one group, of at most MAX_GROUP rows, and one batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def settle() -> list[tuple]:
            if not held or (len(held) == 1 and held[0][7] < 2):
                return []
            covers = covered([r[5] for r in held], [r[6] for r in held], [r[7] for r in held], held[0][1], held[0][2])
            return [(r[3], r[4], c) for r, c in zip(held, covers, strict=True) if c]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["gram", "ctx", "cover"])

        for batch in batches:
            rows: list[tuple] = []
            for r in batch.itertuples(index=False, name=None):
                if held and (r[0], r[1]) != (held[0][0], held[0][1]):
                    rows += settle()
                    held = []
                held.append(r)
            yield frame(rows)
        yield frame(settle())

    columns = ["core", "lo", "hi", "gram", "ctx", "before", "after", "n"]
    sorted_ = groups.select(columns).repartition("core", "lo").sortWithinPartitions("core", "lo")
    return sorted_.mapInPandas(run, "gram bigint, ctx binary, cover array<int>")


def halves(rows: DataFrame) -> DataFrame:
    """Split each row's range of left reaches in two and regroup by the longer core that each half shares."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("z")), F.struct((mid + 1).alias("a"), F.col("hi").alias("z"))))
    rows = rows.withColumn("_p", parts).where("_p.a <= _p.z").withColumn("lo", F.col("_p.a")).withColumn("hi", F.col("_p.z"))
    # The half's strings exist only where the text reaches far enough both ways.
    rows = rows.where((F.length("before") >= F.col("lo")) & (F.length("after") >= LENGTH - F.col("hi")))
    near = F.substring(F.col("before"), F.lit(1), F.col("lo"))
    far = F.substring(F.col("after"), F.lit(1), LENGTH - F.col("hi"))
    # The two lengths follow from lo and hi, so equal bytes are equal pairs; the gram begins the second.
    return rows.withColumn("core", F.unhex(F.md5(F.concat(near, far)))).drop("_p")


def grouped_covers(rows: DataFrame, max_group: int) -> DataFrame:
    """Covers of all cut-outs; groups above ``max_group`` are halved until they fit or are one string."""
    rows = rows.select(
        F.unhex(F.hex("gram")).alias("core"), F.lit(0).alias("lo"), F.lit(REACH).alias("hi"), "gram", "ctx", "before", "after", "n"
    )
    out: DataFrame | None = None
    while True:
        sizes = rows.groupBy("core", "lo").agg(F.count(F.lit(1)).alias("_n"))
        large = sizes.where(F.col("_n") > max_group).select("core", "lo")
        large = written(large, "large-groups")
        if large.isEmpty():
            done = scanned(rows)
            return done if out is None else out.unionByName(done)
        # Both sides are written tables, so a join with a group of very many rows can be split.
        small = scanned(rows.join(large.hint("shuffle_merge"), ["core", "lo"], "left_anti"))
        out = small if out is None else out.unionByName(small)
        big = rows.join(large.hint("shuffle_merge"), ["core", "lo"])
        single = big.where("lo = hi")
        if not single.isEmpty():  # the core is the whole string: more than one cut-out holds it
            cover = F.array((-F.col("lo")).cast("int"), (LENGTH - F.col("lo")).cast("int"))
            out = out.unionByName(single.select("gram", "ctx", cover.alias("cover")))
        rows = written(halves(big.where("lo < hi")), "halves")


def hot_covers(hot: DataFrame, max_group: int) -> DataFrame:
    """What the repeats of hot grams cover: places, first, end. Places stay packed: whether a cut-out stands at more than
    one is told by its least and its greatest."""
    ends = hot.select("gram", "ctx", "before", "after", F.array_min(listed(F.col("places"))).alias("_a"), F.array_max(listed(F.col("places"))).alias("_z"))
    cut = ends.groupBy("gram", "ctx").agg(
        F.first("before").alias("before"), F.first("after").alias("after"), F.when(F.min("_a") < F.max("_z"), 2).otherwise(1).alias("n")
    )
    covers = grouped_covers(written(cut, "cut-outs"), max_group)
    # A cut-out has a cover in each half that it was part of. All of them hold the gram, so together they are one run.
    covers = covers.groupBy("gram", "ctx").agg(F.min(F.get("cover", 0)).alias("first"), F.max(F.get("cover", 1)).alias("end"))
    return hot.select("gram", "ctx", "places").join(written(covers, "covers").hint("shuffle_merge"), ["gram", "ctx"]).select("places", "first", "end")


def name_of(body: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(body.cast("binary")))


def repeated_spans(docs: DataFrame, text: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """Per distinct text with something repeated: name, spans (starts and ends of the maximal repeated
    runs of bytes, in turn); a copied text's spans are null."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.xxhash64(body).alias("node"), name_of(body).alias("name"), body.alias("text")).where(F.octet_length("text") >= LENGTH)
    anchors = written(anchored(texts), "anchors")
    place = F.struct("node", "pos")
    again = anchors.groupBy("gram").agg(F.min(place).alias("_a"), F.max(place).alias("_z"), F.count(F.lit(1)).alias("_n"))
    # Written, so that both sides of the join are plain shuffles and a very common gram can be split.
    again = written(again.where("_a <> _z").select("gram", (F.col("_n") > max_group).alias("hot")), "grams")
    marks = anchors.join(again.hint("shuffle_merge"), "gram").groupBy("node").agg(F.collect_set(F.struct("pos", "gram", "hot")).alias("marks"))
    marks = written(marks.select("node", *[F.col(f"marks.{c}").alias(c) for c in ("pos", "gram", "hot")]), "marks")
    # Marks follow the corpus, so they meet the texts by a shuffle at every size.
    around = texts.join(marks.hint("shuffle_merge"), "node")
    found = written(scanned_places(cut_outs(around)), "found")
    packed = found.where("NOT hot").select("places", "first", "end")
    hot = found.where("hot")
    if not hot.isEmpty():
        packed = packed.unionByName(hot_covers(hot, max_group))
    # One row a place, for all grams alike.
    places = packed.select("first", "end", F.explode(listed(F.col("places"))).alias("place"))
    at = F.conv(F.hex(F.substring("place", 17, 4)), 16, 10).cast("int")
    covers = places.select(F.substring("place", 1, 16).alias("name"), (at + F.col("first")).alias("a"), (at + F.col("end")).alias("z"))
    runs = covers.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("a", "z"))).alias("_s"))
    names = texts.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    copied = written(names.where("_n > 1").select("name"), "copied")
    unique = runs.join(copied, "name", "left_anti")
    kind = "array<bigint>"
    return unique.select("name", joined_runs(F.col("_s")).cast(kind).alias("spans")).unionByName(
        copied.select("name", F.lit(None).cast(kind).alias("spans"))
    )


def joined_runs(pairs: Column) -> Column:
    """Sorted (a, z) pairs merged into maximal runs, flat."""

    def step(out: Column, p: Column) -> Column:
        end = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(end, p["z"])))
        return F.when((F.size(out) > 0) & (p["a"] <= F.get(out, F.size(out) - 1)), grown).otherwise(
            F.concat(out, F.array(p["a"], p["z"]))
        )

    return F.aggregate(pairs, F.array().cast("array<int>"), step)


def without_repeats(docs: DataFrame, text: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """The rows of ``docs`` with kept (binary: the bytes that stay), n_bytes, n_removed, n_spans; columns of
    these names are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    spans = written(repeated_spans(docs, text, max_group), "spans").select(
        F.col("name").alias("_name"), "spans", F.lit(True).alias("_found")
    )
    n = F.octet_length(body)
    # The rows travel as one struct, so their names can't clash with those used here. Spans follow the corpus, so
    # they meet the rows by a shuffle at every size.
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.when(n >= LENGTH, name_of(body)).alias("_name"))
    rows = rows.join(spans.hint("shuffle_merge"), "_name", "left")
    body = F.coalesce(F.col(f"_doc.`{text}`"), F.lit(""))
    n = F.octet_length(body)
    data = F.encode(body, "UTF-8")
    whole = F.col("_found").isNotNull() & F.col("spans").isNull()
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.col("spans"), F.array(n.cast("bigint")))
    left = F.transform(
        F.sequence(F.lit(0), (F.size("spans") / 2).cast("int")),
        lambda i: F.substring(data, (F.get(edges, 2 * i) + 1).cast("int"), (F.get(edges, 2 * i + 1) - F.get(edges, 2 * i)).cast("int")),
    )
    kept = F.when(F.col("_found").isNull(), data).when(whole, F.lit(b"")).otherwise(
        F.aggregate(left, F.lit(b""), lambda a, b: F.concat(a, b))
    )
    gone = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, b: a + b
    )
    size = n.cast("bigint")
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    rows = rows.select(
        "_doc",
        size.alias("n_bytes"),
        F.when(F.col("_found").isNull(), 0).when(whole, size).otherwise(gone).cast("bigint").alias("n_removed"),
        F.when(F.col("_found").isNull(), 0).when(whole, 1).otherwise(F.size("spans") / 2).cast("bigint").alias("n_spans"),
        kept.alias("kept"),
    )
    return rows.select(*[F.col(f"_doc.`{c}`") for c in docs.columns if c not in made], *made)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = without_repeats(docs.select(key, text), text, max_group)
    return rows.select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
