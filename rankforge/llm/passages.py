"""Quality by attention over passages: multiple-instance learning from labels of whole documents.

A document is a bag of passages of 64 words. A passage's input is its byte trigrams, hashed, as roots of shares, and shares that
tell what trigrams cannot: capitals, digits, signs, lines, and words and three-word runs that the text had before. An encoder
(one tanh layer) turns each into a vector; gated attention (a tanh branch times a sigmoid branch) gives each passage a weight,
summing to 1 over the document; the weighted mean vector goes through a logistic unit. Encoder, attention and unit are trained together
by gradients of the document labels alone, then calibrated on documents left out (Platt scaling).

The fit reads at most `MAX_ROWS` labelled documents with at most `MAX_BYTES` of text, whole ones; every document is scored whole.

Defined results: a null text is the empty text, which is one empty passage; without labelled documents all scores are 0.5, with labels of one kind
that label; null labels are not learnt from; equal labelled rows are learnt once; repeated rows are scored each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .kernels import Slice, mixed, slices, window_hashes, windows_inside, word_hashes, words
from .labelled import labelled_rows
from .quality import platt

MAX_ROWS, MAX_BYTES, WORDS, BUCKET_BITS = 3000, 8 << 20, 64, 9
HIDDEN, GATES = 32, 16
_KINDS = ((65, 91), (48, 58), (128, 256))
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[[ord(c) for c in "#*$%&|<>!?@^~=+_{}[]\\/"]] = True
SHARES = 5 + len(_KINDS)
INPUTS = (1 << BUCKET_BITS) + SHARES


def _before(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the same text had the same hash earlier."""
    _, first = np.unique(mixed(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    again = np.ones(len(hashes), dtype=bool)
    again[first] = False
    return again


def inputs(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """A row of inputs per passage, and edges: passages of text i are edges[i]:edges[i + 1]."""
    starts, ends, at = words(piece)
    counts = np.diff(at)
    held = np.maximum(1, -(-counts // WORDS))
    edges = np.append(0, np.cumsum(held))
    total = int(edges[-1])
    owner = np.repeat(np.arange(piece.texts), counts)
    passage = edges[owner] + (np.arange(len(starts)) - at[owner]) // WORDS
    # a passage's bytes reach from its first word to the next passage's
    begins = np.repeat(piece.bounds[:-1], held)
    new = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else np.zeros(0, np.int64)
    later = passage[new] > edges[owner[new]]
    begins[passage[new][later]] = starts[new][later]
    sizes = np.diff(np.append(begins, len(piece.data)))
    of_byte = np.repeat(np.arange(total), sizes)

    raw, out = piece.data, np.zeros((total, INPUTS), dtype=np.float32)
    n = len(raw) - 2
    if n > 0:
        inside = windows_inside(piece.bounds, 3, len(raw))
        packed = (raw[:n].astype(np.uint32) << np.uint32(16)) | (raw[1:n + 1].astype(np.uint32) << np.uint32(8)) | raw[2:]
        bucket = (packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        cells = np.bincount((of_byte[:n][inside] << BUCKET_BITS) + bucket[inside], minlength=total << BUCKET_BITS).reshape(total, -1)
        out[:, :1 << BUCKET_BITS] = np.sqrt(cells / np.maximum(cells.sum(axis=1, keepdims=True), 1))
    bytes_ = np.maximum(sizes, 1)
    in_passage = np.bincount(passage, minlength=total)
    shares = [np.log1p(in_passage) / 4, np.bincount(passage, weights=ends - starts, minlength=total) / np.maximum(in_passage, 1) / 10]
    flags = [(raw >= a) & (raw < b) for a, b in _KINDS] + [_SIGNS[raw]]
    shares += [np.bincount(of_byte[f], minlength=total) / bytes_ for f in flags]
    hashes = word_hashes(piece, starts, ends)
    shares.append(np.bincount(passage[_before(owner, hashes)], minlength=total) / np.maximum(in_passage, 1))
    places = np.flatnonzero(windows_inside(at, 3, len(hashes)))
    runs = window_hashes(hashes, 3)[places]
    shares.append(np.bincount(passage[places][_before(owner[places], runs)], minlength=total) / np.maximum(in_passage, 1))
    out[:, 1 << BUCKET_BITS:] = np.stack(shares, axis=1)
    return out, edges


@dataclass
class Model:
    """Encoder, attention and unit by name; a and b of the calibration; `known` without a network: one score for all."""
    layers: dict[str, np.ndarray]
    a: float = 1.0
    b: float = 0.0
    known: float | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(layers: dict[str, np.ndarray], x: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """Margin of every document, and what the gradients need; `weight` is the attention of each passage."""
    h = np.tanh(x @ layers["encode"] + layers["encode0"])
    t, g = np.tanh(h @ layers["tanh"]), _sigmoid(h @ layers["gate"])
    s = (t * g) @ layers["attend"]
    sizes = np.diff(edges)
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, edges[:-1]), sizes))
    weight = e / np.repeat(np.add.reduceat(e, edges[:-1]), sizes)
    z = np.add.reduceat(weight[:, None] * h, edges[:-1], axis=0)
    return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "margin": z @ layers["unit"] + layers["unit0"][0]}


def gradients(layers: dict[str, np.ndarray], x: np.ndarray, edges: np.ndarray, y: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss of documents."""
    f = forward(layers, x, edges)
    push = (_sigmoid(f["margin"]) - y) * cost
    sizes = np.diff(edges)
    dz = np.repeat(push[:, None] * layers["unit"], sizes, axis=0)
    h, t, g, weight = f["h"], f["t"], f["g"], f["weight"]
    da = (dz * h).sum(axis=1)
    ds = weight * (da - np.repeat(np.add.reduceat(weight * da, edges[:-1]), sizes))
    gated = ds[:, None] * layers["attend"]
    dt, dg = gated * g * (1 - t * t), gated * t * g * (1 - g)
    dh = weight[:, None] * dz + dt @ layers["tanh"].T + dg @ layers["gate"].T
    inner = dh * (1 - h * h)
    return {"encode": x.T @ inner, "encode0": inner.sum(axis=0), "tanh": h.T @ dt, "gate": h.T @ dg, "attend": (t * g).T @ ds,
            "unit": f["z"].T @ push, "unit0": np.array([push.sum()])}


def train(x: np.ndarray, edges: np.ndarray, y: np.ndarray, epochs: int = 15, batch: int = 32, seed: int = 12) -> dict[str, np.ndarray]:
    """Adam over batches of documents."""
    rng = np.random.default_rng(seed)
    made = {"encode": rng.normal(size=(x.shape[1], HIDDEN)) / 4, "encode0": np.zeros(HIDDEN), "tanh": rng.normal(size=(HIDDEN, GATES)) / np.sqrt(HIDDEN),
            "gate": rng.normal(size=(HIDDEN, GATES)) / np.sqrt(HIDDEN), "attend": rng.normal(size=GATES) / np.sqrt(GATES),
            "unit": rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), "unit0": np.zeros(1)}
    layers = {k: v.astype(np.float32) for k, v in made.items()}
    first, second = ({k: np.zeros_like(v) for k, v in layers.items()} for _ in range(2))
    cost = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            mine = order[at:at + batch]
            sizes = (edges[1:] - edges[:-1])[mine]
            local = np.append(0, np.cumsum(sizes))
            rows = np.repeat(edges[mine] - local[:-1], sizes) + np.arange(local[-1])
            found = gradients(layers, x[rows], local, y[mine], cost[mine] / len(mine))
            step += 1
            rate = 0.005 * (1 - epoch / epochs) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
            for k, value in found.items():
                first[k] = 0.9 * first[k] + 0.1 * value
                second[k] = 0.99 * second[k] + 0.01 * value * value
                layers[k] = (layers[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-6) - 1e-4 * layers[k]).astype(np.float32)
    return layers


def _encoded(rows: DataFrame) -> DataFrame:
    """(doc_id, label, text_key, passages) with the passages' inputs as 16-bit numbers."""
    def run(batches):
        for batch in batches:
            for piece in slices(batch.column(3)):
                x, edges = inputs(piece)
                x = x.astype(np.float16)
                mine = batch.slice(piece.first, piece.texts)
                yield pa.RecordBatch.from_arrays(
                    [*mine.columns[:3], pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
                    names=["doc_id", "label", "text_key", "passages"])

    kept = T.StructType([*rows.select("doc_id", "label", "text_key").schema, T.StructField("passages", T.BinaryType())])
    return rows.select("doc_id", "label", "text_key", "text").mapInArrow(run, kept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on bounded labelled rows; every fifth of them is left for the calibration."""
    rows = labelled_rows(docs, labels, label, max_rows, max_bytes, seed=12)
    table = _encoded(rows).toArrow()
    order = np.lexsort((table["label"].to_numpy(), table["text_key"].to_numpy()))
    y = table["label"].to_numpy()[order].astype(np.float32)
    if len(y) == 0:
        return Model({}, known=0.5)
    if len(set(y.tolist())) < 2:
        return Model({}, known=float(y[0] > 0))
    bags = [np.frombuffer(table["passages"][int(i)].as_buffer(), np.float16).reshape(-1, INPUTS) for i in order]
    held = np.arange(len(y)) % 5 == 4

    def joined(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = [bags[i] for i in np.flatnonzero(which)]
        return np.concatenate(mine).astype(np.float32), np.append(0, np.cumsum([len(b) for b in mine]))

    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return Model({}, known=float(y.mean()))
    layers = train(*joined(~held), y[~held])
    a, b = platt(forward(layers, *joined(held))["margin"].astype(float), y[held].astype(float))
    return Model(layers, a, b)


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, score, passages, attended) of every row: the probability of label 1, how many passages, and the most attended one."""
    carry = carry or []
    shared = docs.sparkSession.sparkContext.broadcast(model)  # INPUTS * HIDDEN numbers and smaller layers

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for piece in slices(batch.column(1)):
                x, edges = inputs(piece)
                sizes = np.diff(edges)
                value, top = np.full(piece.texts, fitted.known or 0.0), np.zeros(piece.texts, dtype=np.int64)
                if fitted.known is None:
                    found = forward(fitted.layers, x, edges)
                    value = _sigmoid(fitted.a * found["margin"].astype(float) + fitted.b)
                    owner = np.repeat(np.arange(piece.texts), sizes)
                    top = np.lexsort((-found["weight"], owner))[edges[:-1]] - edges[:-1]
                mine = batch.slice(piece.first, piece.texts)
                yield pa.RecordBatch.from_arrays([mine.column(0), pa.array(value, pa.float64()), pa.array(sizes, pa.int64()), pa.array(top, pa.int64()),
                                                  *mine.columns[2:]], names=["doc_id", "score", "passages", "attended", *carry])

    made = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("passages", T.LongType()),
                         T.StructField("attended", T.LongType()), *[docs.schema[c] for c in carry]])
    return docs.select("doc_id", "text", *carry).mapInArrow(run, made)
