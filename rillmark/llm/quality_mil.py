"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words; all passages are encoded, none is cut off. A passage's features are the
shares of byte classes (each ASCII punctuation mark, case, digits, line ends, non-ASCII), word length and repetition figures
and hashed word frequencies. An encoder h = tanh(W x) and gated attention a ~ exp(w . (tanh(V h) * sigmoid(U h))) weigh the
passages; the score is sigmoid(c . sum(a h) + b). All weights are learned together from document labels, by Adam on the
driver, from a bounded sample of whole documents: of those that have a label and a text the MAX_DOCS with the smallest hashes
of doc_id, and of these, in that order, as many as have MAX_PASSAGES passages together (one that alone has more is left out).
Scoring reads every passage.

Defined cases: null and empty texts are a bag of one empty passage; label rows with null doc_id or null quality, and
documents with contradicting labels, teach nothing; without labels of both kinds every score is the share of label 1 (0.5 if
there are none); rows with the same doc_id are scored each, and the one with the smallest features teaches; an empty
table gives an empty result; very long texts are read whole, passage by passage; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm._shared import apart, cut
from rillmark.llm._tokens import SPACES, Words, buffers, pieces

PASSAGE, BUCKETS = 128, 256
MAX_DOCS, MAX_PASSAGES = 4096, 65_536
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 16, 40, 128, 3e-3, 1e-3, 5
#: Hashed words count this much beside the other features; with full weight a small sample is learned by heart.
WORD_WEIGHT = 0.1
THRESHOLD = 0.3

#: Byte classes: 0-31 the ASCII punctuation marks in code order, then upper case, lower case, digit, space, line end, other control, first byte and later byte of non-ASCII.
_PUNCTUATION = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASSES = 40


def _class_table() -> np.ndarray:
    table = np.full(256, 37, dtype=np.int64)
    for k, b in enumerate(_PUNCTUATION):
        table[b] = k
    for k, chars in ((32, range(0x41, 0x5B)), (33, range(0x61, 0x7B)), (34, range(0x30, 0x3A)), (35, [0x20]), (36, [0x0A])):
        table[list(chars)] = k
    table[0xC0:], table[0x80:0xC0] = 38, 39
    return table


CLASS = _class_table()
N_FEATURES = _CLASSES + 8 + BUCKETS


def passage_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of the texts, and where each text's passages begin (every text has one at least)."""
    raw, offsets = buffers(texts)
    words = Words(raw, offsets, SPACES)
    counts = np.diff(words.first)
    bags = np.maximum(-(-counts // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(bags)])
    n = int(first[-1])
    doc = np.repeat(np.arange(len(counts)), counts)
    passage = first[doc] + (np.arange(len(doc)) - words.first[doc]) // PASSAGE
    # A passage's bytes reach from its first word (for a text's first passage, from the text's start) to the next passage.
    begins = np.empty(n, dtype=np.int64)
    begins[first[:-1]] = offsets[:-1]
    heads = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.zeros(0, np.int64)
    later = heads[np.isin(passage[heads], first[:-1], invert=True)]
    begins[passage[later]] = words.start[later]
    sizes = np.diff(np.concatenate([begins, [len(raw)]]))
    of_byte = np.repeat(np.arange(n), sizes)
    x = np.zeros((n, N_FEATURES), dtype=np.float32)
    classes = np.bincount(of_byte * _CLASSES + CLASS[raw], minlength=n * _CLASSES).reshape(n, _CLASSES)
    x[:, :_CLASSES] = np.sqrt(classes / np.maximum(sizes, 1)[:, None])
    k = np.bincount(passage, minlength=n)
    some = np.maximum(k, 1)
    length = (words.end - words.start).astype(np.float64)
    by = np.lexsort((words.hash, passage)) if len(passage) else np.zeros(0, np.int64)
    ph, pp = words.hash[by], passage[by]
    fresh = np.concatenate([[True], (ph[1:] != ph[:-1]) | (pp[1:] != pp[:-1])]) if len(by) else np.zeros(0, bool)
    echo = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (passage[1:] == passage[:-1])]) if len(by) else np.zeros(0, bool)
    mean = np.bincount(passage, length, n) / some
    dense = [
        k / PASSAGE, np.log1p(k), mean / 10, np.sqrt(np.maximum(np.bincount(passage, length**2, n) / some - mean**2, 0)) / 10,
        np.bincount(passage, length <= 3, n) / some, np.bincount(passage, length >= 12, n) / some,
        np.bincount(pp, fresh, n) / some, np.bincount(passage, echo, n) / some,
    ]
    x[:, _CLASSES : _CLASSES + 8] = np.stack(dense, axis=1)
    buckets = np.bincount(passage * BUCKETS + (words.hash % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    x[:, _CLASSES + 8 :] = np.sqrt(buckets / some[:, None])
    return x, first


class AttentionModel:
    """Encoder, gated attention and classifier; forward over many bags at once, gradients by hand."""

    def __init__(self, rng: np.random.Generator, mean: np.ndarray, scale: np.ndarray):
        draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.mean, self.scale = mean, scale * np.where(np.arange(N_FEATURES) < N_FEATURES - BUCKETS, 1.0, WORD_WEIGHT)
        self.weights = {"W": draw(N_FEATURES, HIDDEN), "B": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.weights, first[:-1]
        bag = np.repeat(np.arange(len(starts)), np.diff(first))
        z = (x - self.mean) * self.scale
        h = np.tanh(z @ p["W"] + p["B"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        m = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "m": m, "bag": bag, "score": 1 / (1 + np.exp(-(m @ p["c"] + p["b"][0])))}

    def gradients(self, f: dict[str, np.ndarray], first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, bag, starts = self.weights, f["bag"], first[:-1]
        d = (f["score"] - y) / len(y)
        dm = d[:, None] * p["c"]
        da = np.einsum("ij,ij->i", f["h"], dm[bag])
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag])
        dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dm[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["z"].T @ dh, "B": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["m"].T @ d, "b": np.array([d.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray) -> AttentionModel | float:
    """The model, or the only score there can be where one class is missing."""
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    rng = np.random.Generator(np.random.PCG64(SEED))
    n = sum(map(len, bags))
    mean = sum(x.sum(axis=0, dtype=np.float64) for x in bags) / n
    model = AttentionModel(rng, mean, 1 / (np.sqrt(sum(((x - mean) ** 2).sum(axis=0) for x in bags) / n) + 0.05))
    first = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])])
            f = model.forward(np.concatenate([bags[i] for i in own]).astype(np.float64), starts)
            step += 1
            for k, grad in model.gradients(f, starts, y[own]).items():
                grad = grad + DECAY * model.weights[k]
                m, v = first[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                model.weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is divisible by 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> AttentionModel | float:
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = cut(known.select("doc_id", F.col("low").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCS))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, ["text"])):
            counts = np.diff(Words(*buffers(batch.column("text")), SPACES).first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.maximum(-(-counts // PASSAGE), 1), pa.int64())], names=["doc_id", "passages"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, ["text"])):
            x, first = passage_features(batch.column("text"))
            rows = [x[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], names=["doc_id", "quality", "bag"])

    sizes = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text").mapInArrow(measure, "doc_id long, passages long")
    sizes = sizes.groupBy("doc_id").agg(F.max("passages").alias("n")).where(F.col("n") <= MAX_PASSAGES)
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # MAX_DOCS rows at most
    fits = cut(sizes.withColumn("_upto", upto).where(F.col("_upto") <= MAX_PASSAGES).select("doc_id"))
    some = docs.select("doc_id", "text").join(F.broadcast(known.join(fits, "doc_id")), "doc_id")
    found = some.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(encode, "doc_id long, quality int, bag binary")
    rows = sorted(found.groupBy("doc_id", "quality").agg(F.min("bag").alias("bag")).collect(), key=lambda r: r.doc_id)  # of repeated rows always the same
    bags = [np.frombuffer(r.bag, dtype=np.float16).reshape(-1, N_FEATURES) for r in rows]
    return train(bags, np.array([float(r.quality) for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.3)."""
    model = fit(docs, labels)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, ["text"], 2 << 20)):
            if isinstance(model, float):
                scores = np.full(batch.num_rows, model)
            else:
                x, first = passage_features(batch.column("text"))
                scores = model.forward(x, first)["score"]
            made = {"score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= THRESHOLD).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    names = [*[c for c in docs.columns if c not in ("score", "predicted")], "score", "predicted"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names[:-2]) + ", score double, predicted int"
    return docs.select(*names[:-2]).mapInArrow(apply, schema)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted to be of low quality."""
    inner, back = apart(docs, "doc_id", "text")
    return back(score_quality(inner, labels).where("predicted = 1"))
