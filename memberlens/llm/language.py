"""Language identification by a byte convolutional network.

A text, in lower case and UTF-8, is cut into windows of fixed length that cover all of it. Every byte has a learned
vector; filters of several widths slide over a window, the maximum of each filter is kept, and a softmax layer turns these
into probabilities of languages. A document has the mean of its windows, weighted by their bytes.

The network is trained in numpy on a bounded sample of labelled texts: at most ``PER_LANGUAGE`` distinct texts per label, chosen
by a hash of the text, and one window of each of ``PER_TEXT`` places in them. The bound does not grow with the data; everything else reads all
rows and whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0; equal texts get equal results; equal
probabilities go to the label that sorts first; labels that are null are not learned; without any labelled text every
document is ``und``. Only the named columns are read, and only the text is an input of a prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.common import by_small_batches, carried, column, in_text_batches, restored

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
PER_LANGUAGE = 1_500
PER_TEXT = 3
STEPS = 500
BATCH = 64
RATE = 0.01

#: Windows that are convolved at once.
CHUNK = 256

#: What may hold a letter. Numbers that are no digits (a half, a circled one) are word characters too, so ``has_letter`` asks again.
WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in WORD.finditer(text))


@dataclass
class Network:
    labels: list[str]
    vectors: np.ndarray  # (256, EMBEDDED); byte 0 is padding and stays zero
    filters: np.ndarray  # (widest * EMBEDDED, filters); narrow filters are zero beyond their width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @property
    def widest(self) -> int:
        return len(self.filters) // self.vectors.shape[1]

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows * positions, widest * EMBEDDED): the vectors that each filter position sees."""
        n, length = windows.shape
        padded = np.zeros((n, length + self.widest - 1), np.uint8)
        padded[:, :length] = windows
        seen = np.lib.stride_tricks.sliding_window_view(padded, self.widest, axis=1)
        return self.vectors[seen].reshape(n * length, -1)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        n, length = windows.shape
        return np.maximum((self.columns(windows) @ self.filters).reshape(n, length, -1).max(1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.pooled(windows[i:i + CHUNK]) for i in range(0, len(windows), CHUNK)]
        return softmax(np.concatenate(parts) @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(text: str, length: int = WINDOW) -> tuple[np.ndarray, int]:
    """The whole text as rows of bytes, the last one filled with zeros, and the number of bytes."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    out = np.zeros((max(1, -(-len(raw) // length)), length), np.uint8)
    out.reshape(-1)[:len(raw)] = raw
    return out, len(raw)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Network:
    """Fit by Adam on cross-entropy, with batches balanced over the labels."""
    names = sorted(set(labels))
    target = np.array([names.index(x) for x in labels])
    data = np.concatenate([windows_of(t)[0][:1] for t in texts])
    rng = np.random.default_rng(seed)
    widest, width = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat([[1.0] * w * EMBEDDED + [0.0] * (widest - w) * EMBEDDED], FILTERS, 0) for w in WIDTHS]).T
    net = Network(
        names, rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(width, np.float32),
        rng.normal(0, 0.2, (width, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    net.vectors[0] = 0
    params = [net.vectors, net.filters, net.bias, net.out, net.out_bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    members = [np.flatnonzero(target == k) for k in range(len(names))]
    for step in range(1, STEPS + 1):
        picked = np.concatenate([rng.choice(m, max(1, BATCH // len(names))) for m in members])
        x, y = data[picked], target[picked]
        n, length = x.shape
        seen = net.columns(x)
        raw = (seen @ net.filters).reshape(n, length, width)
        where = raw.argmax(1)
        top = np.take_along_axis(raw, where[:, None], 1)[:, 0] + net.bias
        kept = np.maximum(top, 0)
        error = softmax(kept @ net.out + net.out_bias)
        error[np.arange(n), y] -= 1
        error /= n
        back = (error @ net.out.T) * (top > 0)
        rows = (np.arange(n)[:, None] * length + where).reshape(-1)  # the one position each filter learned from
        inputs = seen[rows].reshape(n, width, -1)
        grads = [np.zeros_like(net.vectors), np.einsum("nfe,nf->ef", inputs, back) * mask, back.sum(0), kept.T @ error, error.sum(0)]
        to_vectors = back[:, :, None] * net.filters.T[None]
        padded = np.zeros((n, length + widest - 1), np.uint8)
        padded[:, :length] = x
        bytes_seen = padded[np.arange(n)[:, None, None], where[:, :, None] + np.arange(widest)]
        np.add.at(grads[0], bytes_seen.reshape(-1), to_vectors.reshape(-1, EMBEDDED))
        grads[0][0] = 0
        rate = RATE * (1 - step / (STEPS + 1))
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: Column) -> Column:
    """Documents that take no part in learning: crc32 of the key's text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, key: str, text: str, label: str, per_language: int = PER_LANGUAGE,
                    window: int = WINDOW) -> DataFrame:
    """(k, i, label, part): a few parts of ``window`` characters from at most ``per_language`` distinct texts of every label.

    The draw is by the text, so neither a null key nor one that many rows share decides it; k is the text's hash.
    """
    usable = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(F.col(key))).select(
        F.xxhash64(F.col(text), F.lit("language")).alias("h"), F.col(text).alias("t"), F.col(label).cast("string").alias("label"))
    totals = usable.groupBy("label").agg(F.count_distinct("h").alias("n"))
    draw = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = usable.join(F.broadcast(totals), "label").where(draw * F.col("n") < per_language)
    places = F.transform(F.sequence(F.lit(0), F.lit(PER_TEXT - 1)), lambda i: F.pmod(
        F.xxhash64(F.col("h"), i), F.greatest(F.length("t") - F.lit(window // 2), F.lit(1))).cast("int") + 1)
    parts = F.transform(places, lambda at: F.col("t").substr(at, F.lit(window)))
    distinct = chosen.select("h", "label", parts.alias("parts")).dropDuplicates(["h", "label"])
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h"))
    limited = distinct.withColumn("place", order).where(F.col("place") <= per_language)
    return limited.select(F.col("h").cast("string").alias("k"), "label", F.posexplode("parts").alias("i", "part"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """A network from the sample (its size is bounded by the parameter), or None where nothing is labelled."""
    rows = training_sample(docs, key, text, label, per_language).collect()
    rows = sorted(((r["k"], r["i"], r["label"], r["part"]) for r in rows if has_letter(r["part"])))
    return train([r[3] for r in rows], [r[2] for r in rows]) if rows else None


def predict(docs: DataFrame, network: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred and score of every row, from its whole text, with the columns of ``keep``."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(column(text).alias("body"), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), *carried(keep, text))

    @by_small_batches("body")
    def run(batches):
        for frame in batches:
            labels, scores = judged(sent.value, list(frame["body"]))
            yield frame.assign(lang_pred=labels, score=scores)

    return in_text_batches(rows).mapInPandas(run, rows.schema).select("lang_pred", "score", *restored(keep, text))


def judged(network: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and score of each text; windows of several texts are convolved together."""
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    pending: list[tuple[int, np.ndarray, int]] = []

    def settle() -> None:
        chances = network.probabilities(np.concatenate([w for _, w, _ in pending]))
        at = 0
        for i, windows, used in pending:
            weight = np.full(len(windows), float(WINDOW))
            weight[-1] = used - WINDOW * (len(windows) - 1)
            mean = weight @ chances[at:at + len(windows)] / used
            at += len(windows)
            best = int(mean.argmax())
            labels[i], scores[i] = network.labels[best], float(min(1.0, mean[best]))

    held = 0
    for i, body in enumerate(texts):
        if network is None or not body or not has_letter(body):
            continue
        windows, used = windows_of(body)
        pending.append((i, windows, used))
        held += len(windows)
        if held >= 4 * CHUNK:
            settle()
            pending.clear()
            held = 0
    if pending:
        settle()
    return labels, scores
