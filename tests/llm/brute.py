"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_bytes(texts: list[str | None], length: int = 200) -> list[bytearray]:
    """Per text, a mark for each byte that a string found elsewhere covers."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    marks = []
    for d in data:
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        marks.append(mark)
    return marks


def shingle_weights(text: str | None, width: int = 5) -> Counter:
    words = (text or "").lower().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def shingle_sets(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    """The five-word shingles of a text, letters as they are; a text of fewer words is one."""
    words = WORD.findall(text or "")
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def probability_jaccard(a: Counter, b: Counter) -> float:
    if not a or not b:
        return float(len(a) == len(b))
    names = a.keys() | b.keys()
    totals: dict[float, float] = {}
    out = 0.0
    for d in a.keys() & b.keys():
        ratio = a[d] / b[d]
        if ratio not in totals:
            totals[ratio] = sum(max(a[e], b[e] * ratio) for e in names)
        out += a[d] / totals[ratio]
    return out


def near_classes(rows: list[tuple[int, str | None]], similarity: float = 0.8) -> dict[int, int]:
    """The least id of each row's class, by all pairs that share a shingle."""
    sets = {k: shingle_weights(t) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in sets.items():
        for e in s or [()]:
            holders[e].append(k)
    for a, b in {(a, b) for ks in holders.values() for a in ks for b in ks if a < b}:
        if probability_jaccard(sets[a], sets[b]) >= similarity:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in sets}


def repeat_words(text: str | None, width: int = 5) -> int:
    words = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(words) - width + 1):
        at[tuple(words[i : i + width])].append(i)
    return len({j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + width)})


def level_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Targets by reshared excess, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, rest, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        for s in full or free:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
            rest -= target[s]
        free -= full or free
    return target


def main_text(html: str | None) -> str:
    """The block rules over the standard library's parser: every block knows all elements around it, frames are found by
    going over all blocks again after each, and every open block looks at all decided ones."""
    from html.parser import HTMLParser

    from lumispan.llm import html_text as rules

    blocks: list[list] = [["", 0, []]]  # text, linked characters, elements around it

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.open: list[dict] = []
            self.skip = self.seen = 0

        def cut(self) -> None:
            blocks.append(["", 0, list(self.open)])

        def kind(self, tag: str, attrs: list, inside: bool) -> str:
            if tag in rules.NEVER_TAGS:
                return "never"
            kind = "apart" if tag in rules.BAD_TAGS or (tag == "header" and not inside) else ""
            values = dict(attrs)
            if tag in ("html", "body"):
                return kind
            if "hidden" in values or (values.get("aria-hidden") or "").startswith("true") or re.search(r"display\s*:\s*none", values.get("style") or ""):
                return "never"
            if tag in ("main", "p", "a", "b", "i", "em", "strong", "span", "h1"):
                return kind
            cut = lambda v: {x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", v)}
            for name in ("class", "id", "role", "aria-label"):
                value = values.get(name) or ""
                for names in map(cut, value.split()):
                    if names & rules.STATE_WORDS:
                        continue
                    if names & rules.READER_NAMES:
                        return "readers"
                    if names & rules.BAD_NAMES:
                        kind = "apart"
                    elif not kind and names & rules.WEAK_NAMES and not cut(value) & rules.PART_NAMES:
                        kind = "hint"
            return kind

        def handle_starttag(self, tag, attrs):
            if tag in rules.RAW_TAGS:
                self.skip += 1
            if self.skip:
                return
            if tag in rules.BLOCK_TAGS:
                self.cut()
            elif tag == "br":
                blocks[-1][0] += " "
            if tag in rules.VOID_TAGS:
                return
            if tag == "p" and self.open and self.open[-1]["tag"] == "p":
                self.open.pop()
            inside = any(o["tag"] in ("article", "main") for o in self.open)
            self.seen += 1
            self.open.append({"tag": tag, "kind": self.kind(tag, attrs, inside), "n": self.seen})

        def handle_endtag(self, tag):
            if tag in rules.RAW_TAGS:
                self.skip = max(0, self.skip - 1)
                return
            if self.skip:
                return
            if tag in rules.BLOCK_TAGS:
                self.cut()
            if any(o["tag"] == tag for o in self.open):
                while self.open.pop()["tag"] != tag:
                    pass

        def handle_data(self, data):
            if self.skip:
                return
            b = blocks[-1]
            b[0] += data
            if any(o["tag"] == "a" for o in self.open):
                b[1] += len(data.strip())
            b[2] = list(self.open)

    reader = Reader()
    reader.feed(html or "")
    reader.close()
    strong = ("apart", "readers", "never")
    void: set[int] = set()
    stops = lambda t: sum(w.strip(".,;:!?\"'()") in rules.STOP_WORDS for w in t.lower().split()) >= rules.MIN_STOP_DENSITY * len(t.split())
    found = [(" ".join(t.split()), linked, around) for t, linked, around in blocks if t.split()]
    long_ = [(len(t), stops(t), [o for o in around if o["kind"] in strong]) for t, linked, around in found if len(t) >= rules.LONG and 2 * linked <= len(t)]
    refused: set[int] = set()
    while True:
        outside = sum(n for n, good, marks in long_ if (good or not marks) and all(o["n"] in void for o in marks))
        held: Counter = Counter()
        kinds = {}
        for n, good, marks in long_:
            standing = [o for o in marks if o["n"] not in void]
            if good and standing:
                held[standing[0]["n"]] += n
                kinds[standing[0]["n"]] = standing[0]["kind"]
        for n in list(held):
            if n in refused or kinds[n] == "never":
                del held[n]
        if not held:
            break
        n, weight = min(held.items(), key=lambda x: (-x[1], x[0]))
        if outside > (0 if kinds[n] == "readers" else 0.25 * weight):
            refused.add(n)
        else:
            void.add(n)
    rows = []
    for t, linked, around in found:
        apart = any(o["kind"] in strong and o["n"] not in void for o in around)
        rows.append((t, linked, apart, any(o["kind"] == "hint" for o in around), any(o["tag"] in ("article", "main") for o in around)))
    article = any(inside and not apart and not hint for _, _, apart, hint, inside in rows)
    labels = []
    for text, linked, apart, hint, inside in rows:
        if 2 * linked > len(text):
            x = "bad" if apart or hint or len(text) < 200 or linked > 0.9 * len(text) else "open"
        elif apart or (hint and not inside):
            x = "bad"
        elif len(text) < rules.LONG:
            x = "bad" if hint or (article and not inside) else "open"
        elif stops(text):
            x = "good" if inside or not article else "bad"
        else:
            x = "open" if inside else "bad"
        labels.append(x)
    if "good" not in labels:
        for i, (text, linked, apart, hint, inside) in enumerate(rows):
            if not apart and not hint and (inside or not article) and 2 * linked <= len(text) and (len(text) >= rules.LONG or inside):
                labels[i] = "good"
    out = []
    for i, x in enumerate(labels):
        if x == "open":
            before = [(i - j, labels[j] != "good", j) for j in range(i) if labels[j] != "open"]
            after = [(j - i, labels[j] != "good", j) for j in range(i + 1, len(labels)) if labels[j] != "open"]
            near = [min(s)[:2] for s in (before, after) if s and (not rows[i][4] or rows[min(s)[2]][4])]
            x = ("bad" if min(near)[1] else "good") if near else ("good" if rows[i][4] or not article else "bad")
        if x == "good":
            out.append(rows[i][0])
    return "\n\n".join(out)
