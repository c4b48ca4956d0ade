"""License scans by patience alignment.

A template and a text are sequences of words (runs of letters and digits, in lower case). Words that are unique in both are
anchors; the longest increasing subsequence of their places keeps those in one order; the gaps between kept anchors are
aligned in the same way, after equal words at their two ends are matched. The share of template words that are matched
within a stretch not much longer than the template is the coverage.

Where a gap has no unique words, those that occur equally often on both sides are paired in their order.

A copy lacks at most the share of words that the coverage leaves, so among the template's words that are rarest in the text and
together fill more places than that it has at least one. Every occurrence of these in a stretch dense in template words says
where a copy would start; the stretches around all these places are aligned, close ones first, then as far as a copy can reach.

Templates are a parameter; together they must not exceed ``TEMPLATE_WORDS`` words, as they go to every task. A text whose
vocabulary cannot reach the coverage is left after one pass over its words.

Siblings are told apart by marks: version numbers and words such as "lesser" or "noncommercial". A copy has the marks of its
template and none of another sibling between its ends; of siblings in one stretch the one with the most matched words stays.

Defined results: null and empty texts and templates without words match nothing; equal coverages of one license go to
the first place in the text; every row of a repeated key is scanned; an empty table gives no rows. Only key and text are
read. One row per text and license, with the best of its templates.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.license_texts import SHORT_TEXTS, whole_texts

COVERAGE = 0.8
TEMPLATE_WORDS = 100_000

#: Templates of fewer words than this must be matched whole: a few common words say nothing.
SHORT = 10

#: Words of a template whose marks a copy must have.
OPENING = 300

#: How much longer than the template the stretch may be.
STRETCH = 1.5

#: License names and the wording of their notices and whole texts, in ``license_texts.py`` and the folder
#: ``license_texts``.
TEMPLATES = [*SHORT_TEXTS, *whole_texts()]

#: What tells siblings apart: family -> (its names, {mark: pattern over words}). Version numbers after ``HEADS`` are marks too.
FAMILIES = {
    "gnu": (("GPL-", "LGPL-", "AGPL-"), {"lesser": rb"\blesser(?= general)|\blgpl\b", "library": rb"\blibrary(?= general)",
                                         "affero": rb"\baffero(?= general)|\bagpl\b"}),
    "gfdl": (("GFDL-",), {}),
    "cc": (("CC",), {"nc": rb"\bnoncommercial\b|\bnon commercial\b|\bnc\b", "sa": rb"\bsharealike\b|\bshare alike\b|\bsa\b",
                     "nd": rb"\bnoderiv(?:ative)?s\b|\bno deriv(?:ative)?s\b|\bnd\b"}),
    "bsd": (("BSD-",), {"binary": rb"\breproduce the above\b", "endorse": rb"\bendorse\b|\bpromote\b",
                        "advertising": rb"\badvertising materials\b"}),
    "mit": (("MIT", "X11"), {"notice": rb"\bshall be included\b|\bsubstantial portions\b", "advertising": rb"\bused in advertising\b"}),
    "isc": (("ISC", "0BSD"), {"notice": rb"\bappear in all copies\b"}),
    "apache": (("Apache-",), {}),
    "mpl": (("MPL-",), {}),
}
HEADS = (rb"(?:\bversion|\bv|\bpublic licen[sc]e|\bapache licen[sc]e|\bdocumentation licen[sc]e|\battribution|\bcommercial|\bnoncommercial|\bsharealike|\balike|\bnoderiv(?:ative)?s|\bderiv(?:ative)?s"
         rb"|\bby|\bnc|\bsa|\bnd|\ba?l?gpl|\bmpl|\bapache) (\d{1,2}(?: \d{1,2})*)\b|\bv(\d{1,2}(?: \d{1,2})*)\b")
VERSIONED = {"gnu", "gfdl", "cc", "apache", "mpl"}

WORD = re.compile("[a-z0-9]+")
#: Bytes of UTF-8: digits and letters stay, A-Z become small, anything above ASCII breaks a word.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LOWER = str.maketrans({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})

VERSION = re.compile(HEADS)
PATTERNS = {family: {mark: re.compile(p) for mark, p in marks.items()} for family, (_, marks) in FAMILIES.items()}

Match = tuple[int, int]  # place in the template, place in the text


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BYTES).split()


def family_of(name: str) -> str | None:
    return next((f for f, (names, _) in FAMILIES.items() if name.startswith(names)), None)


def marks_of(words: list[bytes], family: str | None) -> list[tuple[int, str]]:
    """(place, mark) of the words that tell the siblings of a family apart."""
    if family is None:
        return []
    joined = b" ".join(words)
    begins = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    found = [(m.start(), mark) for mark, pattern in PATTERNS[family].items() for m in pattern.finditer(joined)]
    if family in VERSIONED:
        for m in VERSION.finditer(joined):
            group = 1 if m.group(1) else 2
            number = m.group(group).decode().replace(" ", ".")
            found.append((m.start(group), "#" + number.removesuffix(".0")))
    return sorted((int(np.searchsorted(begins, at, "right")) - 1, mark) for at, mark in found)


def increasing(places: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for i, place in enumerate(places):
        pile = bisect_left(tops, place)
        before[i] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(place)
            at.append(i)
        else:
            tops[pile], at[pile] = place, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def evenly_repeated(a: Sequence[int], b: Sequence[int], a0: int, a1: int, b0: int, b1: int) -> list[Match]:
    """Pairs of words that stand equally often in both gaps, in order; the rarest number of times there is."""
    at_a, at_b = {}, {}
    for at, seq, low, high in ((at_a, a, a0, a1), (at_b, b, b0, b1)):
        for i in range(low, high):
            at.setdefault(seq[i], []).append(i)
    even = [w for w, where in at_a.items() if len(where) == len(at_b.get(w, ()))]
    fewest = min((len(at_a[w]) for w in even), default=0)
    return [pair for w in even if len(at_a[w]) == fewest for pair in zip(at_a[w], at_b[w])]


def aligned(a: Sequence[int], b: Sequence[int]) -> list[Match]:
    """Matches of two word sequences: anchors, then equal ends, anchors and gaps between anchors.

    The text around a license is no gap, so its ends are matched only once an anchor stands.
    """
    out: list[Match] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while out and a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while out and a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where_b: dict[int, int] = {}
        for j in range(b0, b1):
            where_b[b[j]] = -1 if b[j] in where_b else j
        where_a: dict[int, int] = {}
        for i in range(a0, a1):
            where_a[a[i]] = -1 if a[i] in where_a else i
        common = [(i, where_b[w]) for w, i in where_a.items() if i >= 0 and where_b.get(w, -1) >= 0]
        if not common:
            common = evenly_repeated(a, b, a0, a1, b0, b1)
        common.sort()
        kept = [common[k] for k in increasing([j for _, j in common])]
        out += kept
        ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        if kept:
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:]) if k - i > 1 and m - j > 1]
    return sorted(out)


def densest(matches: list[Match], places: Sequence[int], length: int) -> tuple[int, int, int]:
    """(matches, first place, last place) of the most matches within ``STRETCH`` times the template's length."""
    at = [places[j] for _, j in matches]
    best, low = (0, 0, 0), 0
    for high in range(len(at)):
        while at[high] - at[low] >= STRETCH * length + 1:
            low += 1
        if high - low + 1 > best[0]:
            best = high - low + 1, at[low], at[high]
    return best


def siblings_resolved(found: dict[str, tuple[float, int, int, int]]) -> dict[str, tuple[float, int, int, int]]:
    """Of licenses of one family that lie in each other's stretch the one with the most matched words stays."""
    kept: dict[str, tuple[float, int, int, int]] = {}
    for name, hit in sorted(found.items(), key=lambda x: (-x[1][1], -x[1][0], x[0])):
        family = family_of(name)
        rivals = [k for n, k in kept.items() if family is not None and family_of(n) == family]
        if not any(hit[2] <= k[3] and k[2] <= hit[3] for k in rivals):
            kept[name] = hit
    return kept


class Scanner:
    """Templates as numbers over their common vocabulary."""

    def __init__(self, templates: Sequence[tuple[str, str]], coverage: float = COVERAGE):
        found = [(name, words_of(text)) for name, text in templates]
        found = [(name, words) for name, words in found if words]
        if sum(len(w) for _, w in found) > TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {TEMPLATE_WORDS} words; scan with parts of them")
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, words in found for w in words}))}
        self.names = [name for name, _ in found]
        self.templates = [[self.vocabulary[w] for w in words] for _, words in found]
        self.families = [family_of(name) for name in self.names]
        self.own = [{mark for _, mark in marks_of(words, f)} for (_, words), f in zip(found, self.families)]
        # references to other licenses deep in a whole text may change
        self.must = [{mark for place, mark in marks_of(words, f) if place < OPENING} for (_, words), f in zip(found, self.families)]
        self.shares = np.zeros((len(found), len(self.vocabulary) + 1))
        for t, ids in enumerate(self.templates):
            np.add.at(self.shares[t], ids, 1 / len(ids))
        self.coverage = coverage

    def needed(self, template: list[int]) -> float:
        """Matched words from which on a template counts as found."""
        return len(template) if len(template) < SHORT else self.coverage * len(template) - 1e-9

    def best(self, template: list[int], ids: np.ndarray, places: np.ndarray, marked) -> tuple[int, int, int]:
        """Best alignment of one template; ``ids`` are the known words of the text, ``places`` where they stand. What is not
        ``marked`` is no copy."""
        length, needed = len(template), self.needed(template)
        wanted = np.isin(ids, template)
        words, at = ids[wanted], places[wanted]
        best = (0, 0, 0)
        seeds = self.seeds(template, words, at)
        if not len(seeds):
            return best
        # starts that the seeds name, in steps of a fraction of the template
        step = max(1, length // 8)
        starts = np.unique(seeds // step) * step
        for slack_before, slack_after in ((max(2, length // 16),) * 2, (length // 4,) * 2, (length // 2 + 1, -(-3 * length // 4))):
            for start in starts.tolist():
                low, high = np.searchsorted(at, [start - slack_before, start + step + length + slack_after])
                if high - low < max(needed, best[0] + 1):
                    continue
                result = densest(aligned(template, words[low:high].tolist()), at[low:high].tolist(), length)
                if result[0] > best[0] and marked(*result[1:]):
                    best = result
                    if best[0] == length:
                        return best
        return best

    def seeds(self, template: list[int], words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places at which a copy would start by one of its words; every copy that reaches the coverage is among them."""
        length, needed = len(template), self.needed(template)
        reach = np.searchsorted(at, at + STRETCH * length + 1)  # the end of the stretch from each word on
        dense = reach - np.arange(len(at)) >= needed
        inside = np.zeros(len(at) + 1, np.int64)
        np.add.at(inside, np.flatnonzero(dense), 1)
        np.add.at(inside, reach[dense], -1)
        inside = np.cumsum(inside[:-1]) > 0
        words, at = words[inside], at[inside]
        counts = np.bincount(words, minlength=max(template) + 1)
        stands: dict[int, list[int]] = {}
        for p, w in enumerate(template):
            stands.setdefault(w, []).append(p)
        missed, out = 0, []
        for w in sorted(stands, key=lambda w: (counts[w] * len(stands[w]), w)):
            if counts[w]:
                out.append(np.subtract.outer(at[words == w], stands[w]).ravel())
            missed += len(stands[w])
            if missed > length - needed:
                break
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def in_segments(self, t: int, ids: np.ndarray, places: np.ndarray, marks: list[tuple[int, str]], length: int) -> tuple[int, int, int]:
        """Best copy of a template that has its marks and, between its ends, none of its siblings' marks."""
        foreign = [place for place, mark in marks if mark not in self.own[t]]
        own = {mark: np.array([p for p, m in marks if m == mark], np.int64) for mark in self.must[t]}

        def marked(low: int, high: int) -> bool:
            return all(np.searchsorted(at, low) < np.searchsorted(at, high, "right") for at in own.values())

        best = (0, 0, 0)
        for a, b in zip([-1, *foreign], [*foreign, length]):
            low, high = np.searchsorted(places, [a + 1, b])
            if high - low < self.needed(self.templates[t]) or not marked(a, b):
                continue
            result = self.best(self.templates[t], ids[low:high], places[low:high], marked)
            if result[0] > best[0]:
                best = result
        return best

    def scan(self, text: str | None) -> list[tuple[str, int, float, int, int]]:
        """(license, matched words, coverage, start, end) in characters, of licenses that reach the coverage."""
        words = words_of(text)
        if not words or not self.names:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        present = np.bincount(ids, minlength=len(self.vocabulary) + 1) > 0
        present[0] = False
        possible = np.flatnonzero(self.shares @ present >= self.coverage - 1e-9)
        if not len(possible):
            return []
        places = np.flatnonzero(ids)
        known = ids[places]
        marks = {f: marks_of(words, f) for f in {self.families[t] for t in possible.tolist()}}
        found: dict[str, tuple[float, int, int, int]] = {}
        for t in possible.tolist():
            matched, low, high = self.in_segments(t, known, places, marks[self.families[t]], len(words))
            share = matched / len(self.templates[t])
            if matched >= self.needed(self.templates[t]) and (share, matched) > found.get(self.names[t], (0.0, 0))[:2]:
                found[self.names[t]] = share, matched, low, high
        found = siblings_resolved(found)
        if not found:
            return []
        at = [m.span() for m in WORD.finditer(text.translate(LOWER))]
        return [(name, matched, share, at[low][0], at[high][1]) for name, (share, matched, low, high) in sorted(found.items())]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text",
         coverage: float = COVERAGE) -> DataFrame:
    """key, license, n_matched, coverage, start_char, end_char of every license found in whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(templates, coverage))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for frame in batches:
            out = [(k, *hit) for k, body in zip(frame["key"], frame["body"]) for hit in sent.value.scan(body)]
            yield pd.DataFrame(out, columns=["key", "license", "n_matched", "coverage", "start_char", "end_char"]).astype({"n_matched": "int64", "coverage": "float64", "start_char": "int64", "end_char": "int64"})

    out = rows.mapInPandas(run, f"key {kind}, license string, n_matched long, coverage double, start_char long, end_char long")
    return out.withColumnRenamed("key", key)
