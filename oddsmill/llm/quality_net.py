"""Quality classifier: a convolution over bytes, in numpy.

Each byte has fixed features (its class, and random coordinates); learned filters look at WIDTH consecutive bytes
from every byte on, over chunks that overlap by WIDTH - 1 bytes and together cover the whole text. Each filter's response is max-pooled
within a chunk, and the chunks are combined by the mean over the text and the maximum over the text, which a logistic layer turns into
one probability. As the mean weighs every chunk, a long clean text isn't condemned for one odd place, nor does a chunk of rubbish hide in it.

Fitting takes a bounded, documented sample of labelled rows (FIT_ROWS, the rows of least hash, whole texts of FIT_BYTES at most) to the driver;
scoring streams through all rows with memory bounded by a chunk group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import release, small_batches

FILTERS, WIDTH, CHUNK, SEED = 16, 6, 512, 10
FIT_ROWS, EPOCHS, BATCH, RATE = 1_500, 30, 50, 0.02
#: Bytes of a text that may be learnt from, so that the sample is bounded in bytes too; all texts are scored.
FIT_BYTES = 200_000
#: Bytes of text convolved at a time.
GROUP = 128 << 10


def byte_features(seed: int = SEED) -> np.ndarray:
    """256 x 12: class of the byte (lower, upper, digit, space, line end, mark, other control, not ASCII) and four random coordinates."""
    out = np.zeros((256, 12), np.float32)
    for b in range(256):
        c = chr(b)
        kind = 7 if b >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c in "\r\n" else 5 if 32 < b < 127 else 6
        out[b, kind] = 1
    out[:, 8:] = np.random.default_rng(seed).normal(0, 0.5, (256, 4))
    return out


class Net:
    """filters (WIDTH * 12) x FILTERS with bias, and an output layer over mean and maximum of the chunks' pooled responses."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.features = byte_features(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH * 12, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.out_bias = 0.0

    def pooled(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """chunks x FILTERS: greatest response in each chunk, and the byte where it starts; the bytes, padded."""
        data = np.frombuffer(text, np.uint8)
        if len(data) < WIDTH:
            data = np.concatenate([data, np.full(WIDTH - len(data), 32, np.uint8)])
        places = len(data) - WIDTH + 1
        tops, wheres = [], []
        for base in range(0, places, GROUP):
            n = min(GROUP, places - base)
            piece = self.features[data[base : base + n - 1 + WIDTH]].reshape(-1)
            windows = np.lib.stride_tricks.as_strided(piece, (n, WIDTH * 12), (12 * 4, 4))
            value = np.ascontiguousarray(windows) @ self.filters + self.bias
            pad = -n % CHUNK
            if pad:
                value = np.concatenate([value, np.full((pad, FILTERS), -np.inf, np.float32)])
            value = value.reshape(-1, CHUNK, FILTERS)
            where = value.argmax(axis=1)
            tops.append(np.take_along_axis(value, where[:, None, :], axis=1)[:, 0, :])
            wheres.append(where + base + np.arange(len(value))[:, None] * CHUNK)
        return np.concatenate(tops), np.concatenate(wheres), data

    def forward(self, text: bytes):
        top, where, data = self.pooled(text)
        active = np.maximum(top, 0)
        summary = np.concatenate([active.mean(axis=0), active.max(axis=0)])
        z = float(summary @ self.out + self.out_bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), summary, top, where, data

    def score(self, text: bytes) -> float:
        return float(self.forward(text)[0])

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> Net:
        """Weighted logistic loss, Adam; only the windows that won a pool carry a gradient."""
        rng = np.random.default_rng(seed)
        share = np.clip(labels.mean(), 0.05, 0.95)
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        names = ("filters", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                grad = {name: np.zeros_like(getattr(self, name)) for name in names}
                own = order[k : k + BATCH]
                for i in own:
                    p, summary, top, where, data = self.forward(texts[i])
                    delta = (p - labels[i]) * weight[i] / len(own)
                    grad["out"] += delta * summary
                    grad["out_bias"] += delta
                    flow = np.repeat((delta * self.out[:FILTERS] / len(top))[None], len(top), axis=0)
                    flow[np.maximum(top, 0).argmax(axis=0), np.arange(FILTERS)] += delta * self.out[FILTERS:]
                    flow = flow * (top > 0)
                    window = self.features[data[where[..., None] + np.arange(WIDTH)]].reshape(*where.shape, WIDTH * 12)
                    grad["filters"] += np.einsum("cf,cfw->wf", flow, window)
                    grad["bias"] += flow.sum(axis=0)
                step += 1
                for name in names:
                    g = grad[name] + 1e-4 * getattr(self, name)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    move = RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, getattr(self, name) - move)
        return self


def fit(docs: DataFrame, marks: DataFrame, fit_rows: int = FIT_ROWS) -> Net:
    """A net from docs(doc_id, text) and marks(doc_id, quality): the fit_rows marks of least hash, with the whole texts of their documents.

    Rows without text, id or label don't count. With no rows, or one label only, the net answers with the smoothed share of label 1.
    The marks are bounded by fit_rows, so they are broadcast and no text is shuffled.
    """
    drawn = (
        marks.where("quality is not null and doc_id is not null")
        .select("doc_id", (F.col("quality") > 0).cast("int").alias("label"), F.xxhash64("doc_id", F.lit(SEED)).alias("draw"))
        .orderBy("draw", "doc_id", "label")
        .limit(fit_rows)
    )
    rows = docs.where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(drawn), "doc_id").select("draw", "doc_id", "text", "label").collect()
    rows = sorted(rows, key=lambda r: (r["draw"], r["doc_id"], r["text"], r["label"]))
    labels = np.array([r["label"] for r in rows], np.float64)
    net = Net()
    if len(set(labels)) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        net.out[:] = 0
        net.out_bias = float(np.log(share / (1 - share)))
        return net
    return net.fit([r["text"].encode() for r in rows], labels)


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """docs' columns, then score for every row of docs: the probability of label 1, from the whole text alone.

    A null text is empty; an empty text is scored like spaces. Columns of docs named score are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "score"))
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches):
        for batch in batches:
            scores = [held.value.score(t or b"") for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(work, schema)


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; a document with several labels is learnt with each.

    Null and empty texts are scored like spaces. Rows are scored one by one, so repeated rows have one score each; rows of one doc_id are all learnt
    from. A score equal to the threshold is predicted 1. Columns other than doc_id, text, quality are ignored.
    """
    from .language_id import held_out

    rows = docs.select("doc_id", "text").withColumn("held_out", held_out("doc_id", 4, 2))
    marks = labels.select("doc_id", "quality")
    net = fit(rows.select("doc_id", "text"), marks.where(~held_out("doc_id", 4, 2)))
    out = scored(rows, net)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
