"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words.  Every passage is encoded
from surface statistics and a fixed random projection of its hashed words;
gated attention (Ilse et al., 2018) weighs the passages, and a logistic unit
scores the weighted sum.  Only document labels are learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import mapped
from .langid import bounded
from .textkit import Hasher, Words, byte_table, mix, runs, shingles, utf8

PASSAGE, PROJECTED, BUCKETS = 64, 16, 4096
#: Bytes by class: lower and upper case letters, digits, sentence marks, other ASCII symbols, lead bytes beyond ASCII, line ends.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "#*$%&|<>!@=_+/\\^~`[]{}", None, "\n")
N_STATS = len(CLASSES) + 6
WIDTH = N_STATS + PROJECTED


def class_table() -> np.ndarray:
    t = np.full(256, len(CLASSES), np.int64)
    for i, chars in enumerate(CLASSES):
        if chars:
            t[list(chars.encode())] = i
    t[192:] = 5
    return t


def projection(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, PROJECTED)).astype(np.float32)


class Encoder:
    """Passage features of a run of rows."""

    def __init__(self):
        self.hasher, self.table, self.classes, self.project = Hasher(), byte_table(False), class_table(), projection()

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, first): a row of features for each passage; passages first[i]:first[i+1] are those of row i. An empty row has one passage of zeros."""
        words = Words(data, off, self.table)
        h = self.hasher.spans(words.data, words.starts, words.ends)
        per = np.diff(words.first)
        parts = np.maximum(1, -(-per // PASSAGE))
        first = np.concatenate([[0], np.cumsum(parts)])
        row = np.repeat(np.arange(len(per)), parts)
        nth = np.arange(first[-1]) - first[row]
        a = words.first[row] + PASSAGE * nth
        b = np.minimum(a + PASSAGE, words.first[row + 1])
        n = np.maximum(b - a, 1).astype(np.float32)
        out = np.zeros((len(row), WIDTH), np.float32)
        some = np.flatnonzero(b > a)
        if not len(some):
            return out, first
        begin, end = words.starts[a[some]], words.ends[b[some] - 1]
        kinds = self.classes[data]
        size = (end - begin).astype(np.float32)
        for c in range(len(CLASSES)):
            total = np.concatenate([[0], np.cumsum(kinds == c, dtype=np.int64)])
            out[some, c] = (total[end] - total[begin]) / size
        groups = a[some]
        length = (words.ends - words.starts).astype(np.float32)
        k = len(CLASSES)
        out[some, k] = np.add.reduceat(length, groups) / n[some] / 10
        out[some, k + 1] = np.sqrt(np.maximum(0, np.add.reduceat(length**2, groups) / n[some] - (10 * out[some, k]) ** 2)) / 10
        passage = np.repeat(np.arange(len(some)), (b - a)[some])
        for j, keys in enumerate((h, np.append(shingles(h, 2), np.zeros(1, np.uint64)))):
            tagged = np.sort(keys ^ mix(passage.astype(np.uint64) + np.uint64(7)))
            order = np.argsort(keys ^ mix(passage.astype(np.uint64) + np.uint64(7)), kind="stable")
            same = np.concatenate([[False], tagged[1:] == tagged[:-1]])
            out[some, k + 2 + j] = np.bincount(passage[order], weights=same, minlength=len(some)) / n[some]
        out[some, k + 4] = np.log1p(n[some]) / 4
        out[some, k + 5] = np.log1p(per[row[some]]) / 10
        vectors = self.project[(h >> np.uint64(52)).astype(np.int64)]
        out[some, N_STATS:] = np.add.reduceat(vectors, groups, axis=0) / np.sqrt(n[some])[:, None]
        return out, first


class GatedAttention:
    """encode: tanh(x W); attention: softmax of u . (tanh(e V) * sigmoid(e G)); score: sigmoid(w . sum a e + b)."""

    def __init__(self, width: int = WIDTH, encoded: int = 24, gate: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w = {"W": r.normal(0, width**-0.5, (width, encoded)), "c": np.zeros(encoded), "V": r.normal(0, encoded**-0.5, (encoded, gate)), "G": r.normal(0, encoded**-0.5, (encoded, gate)), "u": r.normal(0, gate**-0.5, gate), "w": np.zeros(encoded), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray):
        w, at = self.w, first[:-1]
        bag = np.repeat(np.arange(len(at)), np.diff(first))
        e = np.tanh(((x - self.mean) / self.scale) @ w["W"] + w["c"])
        t, g = np.tanh(e @ w["V"]), 1 / (1 + np.exp(-(e @ w["G"])))
        s = (t * g) @ w["u"]
        s = np.exp(s - np.maximum.reduceat(s, at)[bag])
        a = s / np.add.reduceat(s, at)[bag]
        z = np.add.reduceat(a[:, None] * e, at, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["w"] + w["b"][0], -30, 30)))
        return bag, e, t, g, a, z, p

    def gradients(self, x, first, y, weight):
        w = self.w
        bag, e, t, g, a, z, p = self.forward(x, first)
        d = (p - y) * weight
        dz = d[:, None] * w["w"]
        da = (dz[bag] * e).sum(1)
        ds = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
        dt, dg = ds[:, None] * w["u"] * g * (1 - t**2), ds[:, None] * w["u"] * t * g * (1 - g)
        de = (a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["G"].T) * (1 - e**2)
        return {"W": ((x - self.mean) / self.scale).T @ de, "c": de.sum(0), "V": e.T @ dt, "G": e.T @ dg, "u": (t * g).T @ ds, "w": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        share = np.clip(y.mean(), 0.02, 0.98)
        weights = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                x = np.concatenate([bags[i] for i in pick])
                first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
                grads = self.gradients(x, first, y[pick], weights[pick] / len(pick))
                step += 1
                for k, gr in grads.items():
                    gr = gr + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.99 * v[k] + 0.01 * gr**2
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample_rows: int = 4_000) -> GatedAttention:
    """Learn from the documents of about `sample_rows` labels (0 or 1; others are left out).

    The labels are sampled before the join, so what is broadcast is bounded by sample_rows, and so are the documents
    where an id repeats; features of all passages of the documents, 116 bytes each, reach the driver."""
    known = labels.filter(F.col(label_col).isin(0, 1)).select(id_col, label_col).dropna()
    sample = bounded(known, sample_rows, id_col, label_col).distinct()
    rows = bounded(docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(id_col, text_col, label_col), 2 * sample_rows, id_col, text_col, label_col)

    def make():
        encode = Encoder()

        def run(batch):
            raw, off = utf8(batch.column(1))
            feats = []
            for lo, hi in runs(off):
                x, first = encode(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                feats += [x[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(feats, pa.binary())], ["doc_id", "label", "x"])

        return run

    got = mapped(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")), make, "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "label"], kind="stable")
    model = GatedAttention()
    if len(got):
        model.fit([np.frombuffer(b, np.float32).reshape(-1, WIDTH).astype(np.float64) for b in got.x], got.label.to_numpy(float))
    return model


def score_documents(docs: DataFrame, model: GatedAttention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text, all its passages.

    Null, empty and wordless texts are bags of one passage of zeros and are scored like any other. Repeated rows are
    repeated; an empty table gives an empty result; other columns are ignored. A model without labels scores 0.5."""

    def make():
        encode = Encoder()

        def run(batch):
            raw, off = utf8(batch.column(1))
            scores = []
            for lo, hi in runs(off):
                x, first = encode(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                scores.append(model.forward(x.astype(np.float64), first)[-1])
            p = np.concatenate(scores)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

        return run

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, score double, predicted int")
