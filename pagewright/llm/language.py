"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows, each filter's largest response in a window
is kept, and a softmax turns these into language probabilities. A text's result is the mean over all
of its windows, weighted by their bytes. Trained in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import materialize

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
# Bound of the training sample: windows in all, and windows per sampled text.
SAMPLE_WINDOWS = 8000
WINDOWS_PER_TEXT = 2
EPOCHS = 8
BATCH = 64
RATE = 0.005
SEED = 42
UNKNOWN = "und"
# Score over which a prediction counts more than the language that a row has: texts of two languages and short ones score less.
SURE = 0.9


@dataclass
class Network:
    labels: list[str]
    filters: list[np.ndarray]  # per width: (width, 256, FILTERS)
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray


def _windows_of(data: bytes) -> np.ndarray:
    """All windows of a text; the last is filled up with spaces."""
    count = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(count * WINDOW, b" "), np.uint8).reshape(count, WINDOW)


def _responses(net: Network, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest responses (windows, widths x FILTERS) and where they lie, for training."""
    found, places = [], []
    for width, kernel, offset in zip(WIDTHS, net.filters, net.offsets):
        span = WINDOW - width + 1
        total = kernel[0][windows[:, :span]]
        for j in range(1, width):
            total = total + kernel[j][windows[:, j : j + span]]
        at = total.argmax(axis=1)
        places.append(at)
        found.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0, :] + offset)
    return np.maximum(np.concatenate(found, axis=1), 0), places


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, targets: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on cross-entropy. Only the place of a filter's largest response passes its gradient on."""
    rng = np.random.default_rng(seed)
    net = Network(
        labels, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype("f4") for w in WIDTHS], [np.zeros(FILTERS, "f4") for _ in WIDTHS],
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype("f4"), np.zeros(len(labels), "f4"),
    )
    parts = [*net.filters, *net.offsets, net.weights, net.bias]
    mean, square, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for begin in range(0, len(order), BATCH):
            x, y = windows[order[begin : begin + BATCH]], targets[order[begin : begin + BATCH]]
            hidden, places = _responses(net, x)
            error = _softmax(hidden @ net.weights + net.bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ net.weights.T) * (hidden > 0)
            slopes = []
            for k, width in enumerate(WIDTHS):
                own, slope = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(net.filters[k])
                rows, units = np.nonzero(own)
                at = places[k][rows, units]
                for j in range(width):
                    np.add.at(slope[j], (x[rows, at + j], units), own[rows, units])
                slopes.append(slope)
            slopes += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            slopes += [hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(parts, slopes, mean, square):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Classifier:
    """Applies a network to many windows; pairs of bytes are looked up together."""

    def __init__(self, net: Network):
        self.net = net
        # Responses of bytes (j, j + 1) of a filter, by width and pair: two bytes cost one look-up.
        self.tables = []
        for width, kernel in zip(WIDTHS, net.filters):
            table = [(j, (kernel[j][:, None, :] + kernel[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, width - 1, 2)]
            self.tables.append((width, table, kernel[width - 1] if width % 2 else None))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.net.labels)), "f4")
        for begin in range(0, len(windows), 64):
            x = windows[begin : begin + 64]
            pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
            found = []
            for (width, table, single), offset in zip(self.tables, self.net.offsets):
                span = WINDOW - width + 1
                total = None
                for j, values in table:
                    got = values.take(pairs[:, j : j + span].ravel(), axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                if single is not None:
                    total += single.take(x[:, width - 1 : width - 1 + span].ravel(), axis=0)
                found.append(total.reshape(len(x), span, FILTERS).max(axis=1) + offset)
            out[begin : begin + 64] = _softmax(np.maximum(np.concatenate(found, axis=1), 0) @ self.net.weights + self.net.bias)
        return out


_LETTER = r"[^\W\d_]"


def _predictions(net: Network, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    classifier, letter = Classifier(net), re.compile(_LETTER)
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    waiting: list[tuple[int, np.ndarray, int]] = []
    sums = np.zeros((len(texts), len(net.labels)))

    def flush():
        windows = np.concatenate([w for _, w, _ in waiting])
        got = classifier.probabilities(windows)
        owner = np.repeat([i for i, _, _ in waiting], [len(w) for _, w, _ in waiting])
        share = np.concatenate([np.r_[np.full(len(w) - 1, WINDOW), n - WINDOW * (len(w) - 1)] for _, w, n in waiting])
        np.add.at(sums, owner, got * share[:, None])
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        value = text.as_py()
        if value and letter.search(value):
            data = value.encode()
            # Very long texts pass through in stretches of whole windows.
            for at in range(0, len(data), WINDOW * 4096):
                piece = data[at : at + WINDOW * 4096]
                windows = _windows_of(piece)
                waiting.append((i, windows, len(piece)))
                held += len(windows)
                if held >= 4096:
                    flush()
                    held = 0
            names[i] = ""
    if waiting:
        flush()
    for i, name in enumerate(names):
        if name == "":
            best = int(sums[i].argmax())
            names[i], scores[i] = net.labels[best], sums[i, best] / sums[i].sum()
    return names, scores


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", windows: int = SAMPLE_WINDOWS) -> Network | None:
    """Network trained on at most about `windows` windows of `labelled`, the same number for each label.

    Rows are picked by a hash of their key, windows by a hash of key and number, anywhere in the text.
    None if no row has a label and a letter.
    """
    usable = labelled.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = materialize(usable.groupBy(label).agg(F.count("*").alias("n")), "labels")
    kinds = counts.count()
    if not kinds:
        return None
    # A third more than needed, as the hash picks a random number; cut below.
    share = F.lit(windows / WINDOWS_PER_TEXT / kinds * 4 / 3) / F.col("n")
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = usable.select(text, label, key).join(counts, label).where(draw < share)
    starts = [
        F.pmod(F.xxhash64(F.lit(SEED + 1 + i), F.col(key)), F.greatest(F.lit(1), F.length(text) - WINDOW // 2)).cast("int") + 1
        for i in range(WINDOWS_PER_TEXT)
    ]
    cut = picked.select(label, key, *[F.substr(F.col(text), s, F.lit(WINDOW)).alias(f"w{i}") for i, s in enumerate(starts)])
    rows = sorted((r[1] if r[1] is not None else -1, r[0], *r[2:]) for r in cut.limit(2 * windows).collect())
    labels = sorted({r[1] for r in rows})
    if not labels:
        return None
    data, targets = [], []
    for _, name, *pieces in rows:
        for piece in pieces:
            data.append(np.frombuffer(piece.encode()[:WINDOW].ljust(WINDOW, b" "), np.uint8))
            targets.append(labels.index(name))
    return train(np.stack(data), np.array(targets), labels)


def predicted(docs: DataFrame, net: Network | None, key: str | None = None, text: str = "text") -> DataFrame:
    """`docs` (or only `key` of it) with `lang_pred` and `score`, the probability of that label.

    Texts that are null or have no letter, and all texts without a network, get `und` and 0.
    """
    # A text that is carried anyway goes to Python and back once.
    carried = docs.select(key, F.col(text).alias("__text")) if key else docs
    n_carried, read = (1, 1) if key else (len(docs.columns), docs.columns.index(text))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(read)
            if net is None:
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                names, scores = _predictions(net, texts)
            columns = [*batch.columns[:n_carried], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:n_carried], "__lang_pred", "__lang_score"])

    schema = carried.select(*carried.columns[:n_carried]).schema.add("__lang_pred", "string").add("__lang_score", "double")
    found = carried.mapInArrow(apply, schema)
    return found.withColumnsRenamed({"__lang_pred": "lang_pred", "__lang_score": "score"})


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def language_id(docs: DataFrame) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score)`: trained on the rows that are not held out (a null id is not)."""
    net = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = predicted(docs, net, "doc_id")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def identified(
    docs: DataFrame, lang: str = "lang", languages: list[str] | None = None, least_score: float = 0.0, corrected_over: float | None = None
) -> DataFrame:
    """`docs` whose language is found, is one of `languages` (None: any) and has `least_score` or more.

    A null `lang` becomes the predicted language, and so does a given one if the score is more than `corrected_over` (None:
    never); other columns and values stay as they are.
    """
    net = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    # Other names than those of the prediction; the texts stand in one column only.
    marked = docs.toDF(*[f"__in_{i}" for i in range(len(docs.columns))])
    stays = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)
    if languages is not None:
        stays = stays & F.col("lang_pred").isin(languages)
    given = dict(zip(docs.columns, marked.columns))
    surely = F.lit(False) if corrected_over is None else F.col("score") > corrected_over
    named = F.when(surely, F.col("lang_pred")).otherwise(F.coalesce(given[lang], "lang_pred"))
    columns = [(named if c == lang else F.col(given[c])).alias(c) for c in docs.columns]
    return predicted(marked, net, text=given["text"]).where(stays).select(*columns)
