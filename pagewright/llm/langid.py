"""Language identification by a convolutional network over bytes.

Filters of several widths slide over the one-hot bytes of fixed-length windows; each
filter's maximum over the window goes through a rectifier into a softmax over the
languages. A text's windows are averaged by their lengths. The network is trained in
numpy, on the driver, on a bounded sample of labelled rows.

As inputs are one-hot, a filter's response is a sum of table rows, one for each byte it
covers; neighbouring bytes are looked up as pairs, in tables of 65,536 rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_column, fresh

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 256
#: Bounds of the training sample: rows of each language, windows of each row, and windows of the stretch of a row that these are drawn from.
ROWS_PER_LANGUAGE, WINDOWS_PER_ROW, STRETCH = 400, 3, 8
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 5
#: What is predicted for a text without letters.
UNKNOWN = "und"


@dataclass
class Network:
    """``tables[w]`` has a (256, FILTERS) table for each byte of a filter of width w."""

    labels: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def windows_of(text: str) -> np.ndarray:
    """The whole text as rows of WINDOW bytes; zeros fill the last."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, WINDOW)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str]) -> Network:
    """Fit the network by Adam on cross-entropy. Deterministic for the same sample in any order."""
    known = sorted(set(labels))
    rng = np.random.default_rng(SEED)
    xs, ys = [], []
    for text, label in sorted(zip(texts, labels, strict=True)):
        w = windows_of(text)
        if len(w) > WINDOWS_PER_ROW:
            w = w[np.sort(rng.choice(len(w), WINDOWS_PER_ROW, replace=False))]
        xs += [*w]
        ys += [known.index(label)] * len(w)
        short = int(rng.integers(8, WINDOW))  # part of a window, as in short texts
        xs.append(np.where(np.arange(WINDOW) < short, w[0], 0).astype(np.uint8))
        ys.append(known.index(label))
    x, y = np.stack(xs), np.array(ys)
    params: dict = {("t", w): rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS}
    params |= {"b": np.zeros(len(WIDTHS) * FILTERS), "w": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(known))), "o": np.zeros(len(known))}
    first, second = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}
    # Languages weigh the same, however many windows they have.
    weight = (len(y) / len(known) / np.bincount(y, minlength=len(known)))[y]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = order[at : at + BATCH]
            b, n = x[pick], len(pick)
            pooled, where = [], []
            for w in WIDTHS:
                t = params["t", w]
                r = sum(t[j][b[:, j : WINDOW - w + 1 + j]] for j in range(w))
                where.append(r.argmax(axis=1))
                pooled.append(np.take_along_axis(r, where[-1][:, None], 1)[:, 0])
            hidden = np.concatenate(pooled, 1) + params["b"]
            active = np.maximum(hidden, 0)
            p = softmax(active @ params["w"] + params["o"])
            p[np.arange(n), y[pick]] -= 1
            p *= weight[pick, None] / n
            back = (p @ params["w"].T) * (hidden > 0)
            grads: dict = {"w": active.T @ p, "o": p.sum(0), "b": back.sum(0)}
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(params["t", w])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(b, where[i] + j, 1), np.arange(FILTERS)[None]), part)
                grads["t", w] = g
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(known, {w: params["t", w].astype(np.float32) for w in WIDTHS}, params["b"], params["w"], params["o"])


class Scorer:
    """Applies a network to texts, a bounded number of windows at a time."""

    def __init__(self, net: Network) -> None:
        self.net = net
        t2, t3, t4 = (net.tables[w] for w in (2, 3, 4))
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        #: Of two bytes: all of the width 2, and the first two of 3 and 4.
        self.pairs = np.concatenate([pair(*t2), pair(*t3[:2]), pair(*t4[:2])], 1)
        self.third, self.rest = t3[2], pair(*t4[2:])

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities (windows, languages)."""
        out = []
        for i in range(0, len(x), 32):
            b = x[i : i + 32].astype(np.intp)
            two = b[:, :-1] * 256 + b[:, 1:]
            r = self.pairs.take(two, axis=0)
            f = FILTERS
            m3 = (r[:, :-1, f : 2 * f] + self.third.take(b[:, 2:], axis=0)).max(axis=1)
            m4 = (r[:, :-2, 2 * f :] + self.rest.take(two[:, 2:], axis=0)).max(axis=1)
            hidden = np.concatenate([r[:, :, :f].max(axis=1), m3, m4], 1) + self.net.bias
            out.append(np.log(softmax(np.maximum(hidden, 0) @ self.net.weights + self.net.offset) + 1e-9))
        return np.concatenate(out)

    def text(self, text: str) -> tuple[str, float]:
        """Label and its probability, from the mean of the windows weighted by their bytes."""
        x = windows_of(text)
        size = np.full(len(x), float(WINDOW))
        size[-1] = max(1, len(text.encode("utf-8", "replace")) - WINDOW * (len(x) - 1))
        p = softmax((self.windows(x) * size[:, None]).sum(0, keepdims=True) / size.sum())[0]
        return self.net.labels[int(p.argmax())], float(p.max())


def fold_of(id_col: str = "doc_id") -> Column:
    """The fold of a row, by its id; null for a null id."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Network | None:
    """Train on a sample of the labelled rows outside the held-out fold, or None if there are none.

    All labels are learned, from at most ROWS_PER_LANGUAGE rows each, those whose hashed ids
    come first.
    """
    rows = docs.where(F.col(label_col).isNotNull() & (F.coalesce(fold_of(id_col), F.lit(0)) != 2) & F.col(text_col).rlike(r"\p{L}"))
    counts = rows.groupBy(F.col(label_col).alias("label")).count().orderBy(F.desc("count"), "label").collect()
    if not counts:
        return None
    share = F
    for label, n in counts:  # one expression, however many labels
        share = share.when(F.col(label_col) == label, min(1.0, 1.5 * ROWS_PER_LANGUAGE / n))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30)) / float(1 << 30)
    texts, labels = [], []
    chosen = rows.where(drawn < share).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(id_col).alias("h"))
    # For training only, a stretch of each text from a hashed place: a few windows are drawn from it.
    span = STRETCH * WINDOW
    begin = F.pmod("h", F.greatest(F.length("text") - span, F.lit(1))).cast("int") + 1
    cut_text = F.call_function("substring", F.col("text"), begin, F.lit(span))
    taken: dict[str, int] = {}
    found = chosen.select("label", cut_text.alias("text"), "h").orderBy("h", "text").limit(2 * ROWS_PER_LANGUAGE * len(counts)).collect()
    for r in found:
        taken[r["label"]] = taken.get(r["label"], 0) + 1
        if taken[r["label"]] <= ROWS_PER_LANGUAGE:
            texts.append(r["text"])
            labels.append(r["label"])
    return train(texts, labels) if texts else None


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and the predicted language and its score (0 to 1).

    Every window of every text is scored. A text that is null or has no letter gets
    UNKNOWN with score 0, and so do all texts if there was nothing to train on. Columns
    of ``docs`` with the names in ``out`` are replaced.
    """
    docs = docs.drop(*out)
    (own,) = fresh(docs, "text")

    def make():
        scorer = Scorer(net) if net else None

        def of(batch: list) -> list[list]:
            said = [scorer.text(t) if scorer and t is not None else (UNKNOWN, 0.0) for t in batch]
            return [[s[0] for s in said], [s[1] for s in said]]

        return of

    text = F.col(text_col)
    fed = docs.withColumn(own, F.when(text.rlike(r"\p{L}"), text))
    return by_column(fed, own, make, f"`{out[0]}` string, `{out[1]}` double")
