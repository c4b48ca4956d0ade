"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside fixed patterns.

The patterns give base spans, which always stay. The network, trained in numpy on a bounded sample of texts labelled by
those spans, reads every character of every text in overlapping windows; the Viterbi path of each window is decoded, the
inner parts of the windows are put together to one labelling of the text, and its runs are added as spans where they touch
no base span and reach a minimum length and certainty.

Gates are piecewise linear, so a step is a few passes over small matrices, with many windows side by side.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends exclusive; equal texts get
equal spans; without any labelled character nothing is learned and only base spans are returned. Only key and text are
read, other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.common import by_small_batches, carried, column, in_text_batches, restored
from memberlens.sources.tables import stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match takes whole runs of digits, so none can start inside one.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")

#: Size of the hidden state of a direction; characters a window holds and shares with each neighbour.
HIDDEN = 8
WINDOW = 512
SHARED = 32

#: Windows decoded side by side.
BATCH = 1024

#: Added to the memory at each step, so that it fades to this and not to slow denormal numbers.
TINY = np.float32(1e-20)

#: Training: labelled and plain texts in the sample, characters around a span, steps.
SAMPLE = 3_000
CONTEXT = 96
STEPS = 250
TRAIN_BATCH = 64
RATE = 0.02

#: A text that matches this, or has an at sign, is likely to hold a span.
SIGN = r"[0-9][0-9.() +-]{6}"

#: Spans of one text that are trained on.
SPANS_PER_TEXT = 8

#: An added span has this many characters at least and this mean margin of its label over the next best.
LEAST = 7
MARGIN = 4.0

SPANS = "array<struct<kind:string,start:long,end:long>>"
Span = tuple[int, int, int]  # start, position in KINDS, end


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterable[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their at signs outwards: every sign is
    walked once to the left, while a search from the left would read a long run again from each of its characters."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and non-overlapping per kind; matches that fail their test are dropped."""
    out: list[Span] = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def codes(text: str) -> np.ndarray:
    """A class from 1 to 127 for each character: ASCII is itself, anything else is its code point folded onto 1 to 31."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, np.maximum(points, 1), points % 31 + 1).astype(np.uint8)


@dataclass
class Tagger:
    """Weights. ``inputs[d][g]`` is a table by character class for direction d and gate g (input, forget, output, new), with
    biases; ``states[d][g]`` the weights of the state before."""

    inputs: list[list[np.ndarray]]
    states: list[list[np.ndarray]]
    emit: np.ndarray
    emit_bias: np.ndarray
    moves: np.ndarray

    def traced(self, windows: np.ndarray, direction: int, steps: list) -> np.ndarray:
        """States as ``read`` gives them; ``steps`` receives what back-propagation needs."""
        length, n = windows.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((length, n, HIDDEN), np.float32)
        table, state = self.inputs[direction], self.states[direction]
        for t in range(length) if direction == 0 else range(length - 1, -1, -1):
            raw = [table[g][windows[t]] + h @ state[g] for g in range(4)]
            i, f, o = (np.clip(raw[g], 0, 1) for g in (0, 1, 2))
            new = np.clip(raw[3], -1, 1)
            before = c, h
            c = f * c + i * new + TINY
            squashed = np.clip(c, -1, 1)
            h = o * squashed
            out[t] = h
            steps.append((t, raw, i, f, new, o, before, c, squashed))
        return out

    def read(self, windows: np.ndarray, direction: int) -> np.ndarray:
        """States (length, windows, HIDDEN) in one direction; ``windows`` is (length, windows). Class 0 is padding."""
        length, n = windows.shape
        out = np.empty((length, n, HIDDEN), np.float32)
        gates = np.empty((4, n, HIDDEN), np.float32)
        taken, fed = np.empty((n, 4 * HIDDEN), np.float32), np.empty((n, 4 * HIDDEN), np.float32)
        c, h, part = (np.zeros((n, HIDDEN), np.float32) for _ in range(3))
        table, state = np.concatenate(self.inputs[direction], 1), np.concatenate(self.states[direction], 1)
        for t in range(length) if direction == 0 else range(length - 1, -1, -1):
            np.take(table, windows[t], axis=0, out=taken, mode="clip")
            np.matmul(h, state, out=fed)
            taken += fed
            np.minimum(taken, 1, out=taken)
            gates[:] = taken.reshape(n, 4, HIDDEN).transpose(1, 0, 2)
            np.maximum(gates[:3], 0, out=gates[:3])
            np.maximum(gates[3], -1, out=gates[3])
            c *= gates[1]
            np.multiply(gates[0], gates[3], out=part)
            part += TINY
            c += part
            np.minimum(c, 1, out=part)
            np.maximum(part, -1, out=part)
            h = out[t]
            np.multiply(gates[2], part, out=h)
        return out

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Scores of labels (length, windows, labels)."""
        shape = *windows.shape, len(self.emit_bias)
        one = self.read(windows, 0).reshape(-1, HIDDEN) @ self.emit[:HIDDEN]
        one += self.read(windows, 1).reshape(-1, HIDDEN) @ self.emit[HIDDEN:]
        one += self.emit_bias
        return one.reshape(shape)

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels and the margin of each label's own score over the best other, both (length, windows).

        A stretch of other labels loses the lead of the first label at each of its places and wins at most what its
        transitions have over the first label's own one. Where the lead is larger everywhere, the best path is the first
        label throughout, and only the other windows need a search.
        """
        over = self.moves - self.moves[0, 0]
        gain = max(0.0, float(over[1:, 1:].max()), max(0.0, float(over[0, 1:].max())) + max(0.0, float(over[1:, 0].max())))
        scores = self.scores(windows)
        lead = scores[:, :, 0] - scores[:, :, 1:].max(2)
        label = np.zeros(windows.shape, np.uint8)
        unsure = np.flatnonzero(lead.min(0) <= gain)
        if len(unsure):
            label[:, unsure], lead[:, unsure] = self.best_paths(scores[:, unsure])
        return label, lead

    def best_paths(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, n, k = scores.shape
        best = scores[0]
        origin = np.empty((length, n, k), np.uint8)
        for t in range(1, length):
            step = best[:, :, None] + self.moves
            origin[t] = step.argmax(1)
            best = step.max(1) + scores[t]
        label = np.empty((length, n), np.uint8)
        label[-1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            label[t - 1] = origin[t][rows, label[t]]
        own = np.take_along_axis(scores, label[:, :, None].astype(np.int64), 2)[:, :, 0]
        np.put_along_axis(scores, label[:, :, None].astype(np.int64), -np.inf, 2)
        return label, own - scores.max(2)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def crf_gradients(scores: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood by scores and transitions: expected less observed counts."""
    length, n, k = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[0] = scores[0]
    for t in range(1, length):
        forward[t] = log_sum(forward[t - 1][:, :, None] + moves, 1) + scores[t]
    for t in range(length - 2, -1, -1):
        backward[t] = log_sum(moves + (scores[t + 1] + backward[t + 1])[:, None, :], 2)
    total = log_sum(forward[-1], 1)
    to_scores = np.exp(forward + backward - total[:, None])
    np.put_along_axis(to_scores, gold[:, :, None], np.take_along_axis(to_scores, gold[:, :, None], 2) - 1, 2)
    joint = np.exp(forward[:-1][:, :, :, None] + moves + (scores[1:] + backward[1:])[:, :, None, :] - total[:, None, None])
    to_moves = joint.sum((0, 1))
    np.subtract.at(to_moves, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    return to_scores / n, to_moves / n


def train(windows: np.ndarray, gold: np.ndarray, seed: int = 9) -> Tagger:
    """Fit to (texts, length) classes and labels (0: none, then KINDS from 1) by Adam and back-propagation through time."""
    rng = np.random.default_rng(seed)
    labels = len(KINDS) + 1

    def normal(scale: float, *shape: int) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    tagger = Tagger(
        [[normal(0.3, 128, HIDDEN) + np.float32(b) for b in (0.5, 0.7, 0.5, 0)] for _ in range(2)],
        [[normal(0.2, HIDDEN, HIDDEN) for _ in range(4)] for _ in range(2)],
        normal(0.3, 2 * HIDDEN, labels), np.zeros(labels, np.float32), np.zeros((labels, labels), np.float32))
    params = [*tagger.inputs[0], *tagger.inputs[1], *tagger.states[0], *tagger.states[1], tagger.emit, tagger.emit_bias, tagger.moves]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        picked = rng.choice(len(windows), min(TRAIN_BATCH, len(windows)), replace=False)
        x, y = np.ascontiguousarray(windows[picked].T), np.ascontiguousarray(gold[picked].T)
        length, n = x.shape
        kept: list[list] = [[], []]
        both = np.concatenate([tagger.traced(x, d, kept[d]) for d in range(2)], 2)
        scores = (both.reshape(length * n, -1) @ tagger.emit + tagger.emit_bias).reshape(length, n, labels)
        to_scores, to_moves = crf_gradients(scores, tagger.moves, y)
        flat = to_scores.reshape(length * n, labels)
        to_both = (flat @ tagger.emit.T).reshape(length, n, 2 * HIDDEN)
        grads = [np.zeros_like(p) for p in params]
        grads[16], grads[17], grads[18] = both.reshape(length * n, -1).T @ flat, flat.sum(0), to_moves
        for d in range(2):
            to_h = np.zeros((n, HIDDEN), np.float32)
            to_c = np.zeros((n, HIDDEN), np.float32)
            for t, raw, i, f, new, o, (c_before, h_before), c, squashed in reversed(kept[d]):
                to_h = to_h + to_both[t, :, d * HIDDEN:(d + 1) * HIDDEN]
                to_c = to_c + to_h * o * (np.abs(c) < 1)
                parts = [to_c * new * inside(raw[0], 0), to_c * c_before * inside(raw[1], 0), to_h * squashed * inside(raw[2], 0), to_c * i * inside(raw[3], -1)]
                to_c = to_c * f
                to_h = np.zeros_like(to_h)
                for g, part in enumerate(parts):
                    np.add.at(grads[4 * d + g], x[t], part)
                    grads[8 + 4 * d + g] += h_before.T @ part
                    to_h += part @ tagger.states[d][g].T
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - step / (STEPS + 1))
        for p, g, a, b in zip(params, grads, first, second):
            g = g * min(1.0, 5 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def inside(raw: np.ndarray, low: float) -> np.ndarray:
    return ((raw > low) & (raw < 1)).astype(np.float32)


def labelled_windows(texts: Iterable[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``CONTEXT`` characters around every base span and at random places, with their labels."""
    rng = np.random.default_rng(seed)
    inputs, gold = [], []
    for text in texts:
        spans = base_spans(text)
        label = np.zeros(len(text), np.int64)
        for start, kind, end in reversed(spans):
            label[start:end] = kind + 1
        seen = codes(text)
        places = [max(0, s - int(rng.integers(0, CONTEXT // 2))) for s, _, _ in spans[:SPANS_PER_TEXT]] + [int(rng.integers(0, max(1, len(text) - CONTEXT)))]
        for at in places:
            window, tags = np.zeros(CONTEXT, np.uint8), np.zeros(CONTEXT, np.int64)
            part = seen[at:at + CONTEXT]
            window[:len(part)], tags[:len(part)] = part, label[at:at + CONTEXT]
            inputs.append(window)
            gold.append(tags)
    return np.array(inputs), np.array(gold)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Tagger | None:
    """A tagger from at most ``sample`` distinct texts, half of them with a sign of personal data, drawn by their hashes; None
    without labels."""
    body = column(text)
    hashed = docs.where(body.isNotNull()).select(F.xxhash64(body, F.lit("pii")).alias("h"), body.alias("t"))
    marks = hashed.select("h", (F.instr("t", "@").cast("boolean") | F.col("t").rlike(SIGN)).alias("likely"))
    marks = stored(marks.distinct(), "marks")  # texts are searched once; what follows reads hashes
    totals = marks.groupBy("likely").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.col("h"), F.lit(1 << 30))
    drawn = marks.join(F.broadcast(totals), "likely").where(place / F.lit(float(1 << 30)) * F.col("n") < sample / 2)
    order = F.row_number().over(Window.partitionBy("likely").orderBy(place, "h"))
    listed = drawn.select("h", "likely").withColumn("place", order).where(F.col("place") <= sample // 2).select("h")
    chosen = hashed.join(F.broadcast(listed), "h").dropDuplicates(["h"]).select(F.col("h").cast("string").alias("k"), "t")
    # Long texts give their spans' surroundings; what a task sends to the driver is windows of fixed length.
    schema = "k string, i int, window binary, gold binary"

    def cut(batches):
        for frame in batches:
            for k, t in zip(frame["k"], frame["t"]):
                windows, gold = labelled_windows([t])
                yield pd.DataFrame({"k": k, "i": range(len(windows)), "window": [w.tobytes() for w in windows], "gold": [g.astype(np.uint8).tobytes() for g in gold]})

    found = sorted(tuple(r) for r in chosen.select("k", "t").mapInPandas(cut, schema).collect())
    if not found:
        return None
    windows = np.array([np.frombuffer(r[2], np.uint8) for r in found])
    gold = np.array([np.frombuffer(r[3], np.uint8) for r in found]).astype(np.int64)
    return train(windows, gold) if gold.any() else None


def tag(tagger: Tagger, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labels and margins of every character of every text: windows overlap, each gives its inner part."""
    stride = WINDOW - 2 * SHARED
    sizes = [max(1, -(-max(0, len(t) - 2 * SHARED) // stride)) for t in texts]
    windows = np.zeros((sum(sizes), WINDOW), np.uint8)
    row = 0
    for text, n in zip(texts, sizes):
        seen = codes(text)
        for w in range(n):
            part = seen[w * stride:w * stride + WINDOW]
            windows[row + w, :len(part)] = part
        row += n
    labels, margins = np.empty(windows.shape, np.uint8), np.empty(windows.shape, np.float32)
    longest = np.maximum((windows != 0).sum(1), 1)
    order = np.argsort(longest, kind="stable")  # windows of like length side by side
    for a in range(0, len(order), BATCH):
        rows = order[a:a + BATCH]
        used = int(longest[rows].max())
        label, margin = tagger.decode(np.ascontiguousarray(windows[rows, :used].T))
        labels[rows, :used], margins[rows, :used] = label.T, margin.T
    out, row = [], 0
    for text, n in zip(texts, sizes):
        label, margin = np.empty(len(text), np.uint8), np.empty(len(text), np.float32)
        for w in range(n):
            low = w * stride + (SHARED if w else 0)
            high = len(text) if w == n - 1 else w * stride + WINDOW - SHARED
            inner = slice(low - w * stride, high - w * stride)
            label[low:high], margin[low:high] = labels[row + w, inner], margins[row + w, inner]
        row += n
        out.append((label, margin))
    return out


def added_spans(base: list[Span], label: np.ndarray, margin: np.ndarray) -> list[Span]:
    """Runs of one label that touch no base span and are long and certain enough."""
    if not label.any():
        return []
    edges = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1], [True])))
    taken = np.zeros(len(label) + 2, bool)
    for start, _, end in base:
        taken[start:end + 2] = True  # with a character on each side
    return [
        (int(a), int(label[a]) - 1, int(b)) for a, b in zip(edges[:-1], edges[1:])
        if label[a] and b - a >= LEAST and margin[a:b].mean() >= MARGIN and not taken[a + 1:b + 1].any()
    ]


def find(docs: DataFrame, tagger: Tagger | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
         change: Callable[[str, list[tuple[str, int, int]]], str] | None = None) -> DataFrame:
    """key, base and spans (base and added ones together) of every document; ``keep`` names columns to hand through.

    With ``change``, a text that has spans is handed through as ``change(text, spans)``, from the step that found them: a second
    Python step would hold a second worker beside each of the first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    keep = tuple(c for c in keep if c != key)
    rows = docs.select(column(key).alias("key"), column(text).alias("body"), F.array().cast(SPANS).alias("base"), F.array().cast(SPANS).alias("spans"), *carried(keep, text))

    def shown(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    @by_small_batches("body")
    def run(batches):
        for frame in batches:
            texts = [t or "" for t in frame["body"]]
            base = [base_spans(t) for t in texts]
            both = list(base)
            a = size = 0
            for b in range(len(texts) + 1):  # parts of bounded size, whole texts each
                if b == len(texts) or size > WINDOW * BATCH * 4:
                    if sent.value is not None and b > a:
                        for i, (label, margin) in enumerate(tag(sent.value, texts[a:b]), a):
                            both[i] = sorted(base[i] + added_spans(base[i], label, margin))
                    a, size = b, 0
                if b < len(texts):
                    size += len(texts[b])
            if change is not None:
                frame["body"] = pd.Series([change(t, [(KINDS[k], a, b) for a, k, b in s]) if s else t for t, s in zip(frame["body"], both)], index=frame.index, dtype=object)
            yield frame.assign(base=[shown(s) for s in base], spans=[shown(s) for s in both])

    out = in_text_batches(rows).mapInPandas(run, rows.schema)
    return out.select(F.col("key").alias(key), "base", "spans", *restored(keep, text))


def joined(spans):
    """kind:start:end of every span, comma-joined, in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, a checksum of them, and all spans as text."""
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(key), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not spans:
        return text
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= end:
            out.append(f"{text[end:a]}<{kind.upper()}>")
        end = max(end, b)
    return "".join(out) + text[end:]
