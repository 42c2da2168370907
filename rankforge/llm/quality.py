"""Quality rules: counted base rules and a classifier on hashed word and character n-grams.

The classifier is a logistic regression over hashed features: single words and word pairs, and runs of 3 to 5
bytes, each kind as shares of its own total in the text. It is fitted on labelled rows by batch gradient steps
(Adam on the driver over a bounded sample of rows, whose features are hashed in Spark) and its
margin is calibrated to a probability on rows held out of the fit (Platt scaling). Scoring sends the weights to
every task and runs over Arrow batches. A text is kept if no base rule fails and the probability is at least
`threshold`.

The fit reads at most `MAX_ROWS` labelled rows, chosen by hash, with at most `MAX_BYTES` of text in all, and of each its whole text.
Every text is scored whole.

Defined results: a null text is the empty text; a text without words fails the base rules; with no labelled rows,
or labels of one kind only, the model keeps all and the base rules decide; rows with a null label are
not learnt from; several labels or texts of one doc_id count as rows of their own, equal ones as one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .kernels import Slice, mixed, slices, window_hashes, windows_inside, word_hashes, words
from .labelled import labelled_rows
from .resources import let_go

BITS, MAX_ROWS, MAX_BYTES, THRESHOLD = 16, 3000, 12 << 20, 0.5
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_CHARACTERS = (3, 4, 5)


@dataclass(frozen=True)
class Model:
    """weights of the hashed features, intercept, and the calibration probability = 1 / (1 + exp(-(a * margin + b)))."""
    weights: np.ndarray
    intercept: float
    a: float
    b: float


def features(piece: Slice, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets, and edges (those of text i are edges[i]:edges[i + 1])."""
    shift = np.uint64(64 - bits)
    starts, ends, edges = words(piece)
    hashes = word_hashes(piece, starts, ends)
    for width in (1, 2):
        found = window_hashes(hashes, width)
        inside = windows_inside(edges, width, len(hashes))
        total = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
        yield (mixed(found[inside] + np.uint64(width)) >> shift).astype(np.int64), total[np.minimum(edges, len(inside))]
    raw = piece.data.astype(np.uint64)
    for width in _CHARACTERS:
        n = len(raw) - width + 1
        if n <= 0:
            yield np.zeros(0, np.int64), np.zeros(piece.texts + 1, np.int64)
            continue
        packed = np.full(n, width, dtype=np.uint64)
        for j in range(width):
            packed = (packed << np.uint64(8)) | raw[j:n + j]
        inside = windows_inside(piece.bounds, width, len(raw))
        total = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
        yield (mixed(packed[inside]) >> shift).astype(np.int64), total[np.minimum(piece.bounds, len(inside))]


def margins(piece: Slice, model: Model) -> np.ndarray:
    """Linear score of each text: per kind of feature, the mean weight."""
    out = np.full(piece.texts, model.intercept)
    for kind, (buckets, edges) in enumerate(features(piece)):
        total = np.concatenate(([0.0], np.cumsum(model.weights[kind][buckets])))
        counts = np.diff(edges)
        out += np.where(counts > 0, (total[edges[1:]] - total[edges[:-1]]) / np.maximum(counts, 1), 0)
    return out


def base_counts(piece: Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, edges = words(piece)
    counts = np.diff(edges)
    hashes = word_hashes(piece, starts, ends)
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    letter = ((piece.data & 0xC0) != 0x80) & ~blank[piece.data]

    # words in three-word windows that the text holds twice or more
    triples = window_hashes(hashes, 3)
    at = np.flatnonzero(windows_inside(edges, 3, len(hashes)))
    owner = np.searchsorted(edges, at, side="right") - 1
    key = mixed(triples[at] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = at[times[which] > 1]
    covered = np.zeros(len(hashes) + 3, dtype=bool)
    for j in range(3):
        covered[repeated + j] = True
    spread = np.concatenate(([0], np.cumsum(covered[:len(hashes)], dtype=np.int64)))

    # lines with a word that equal an earlier one: a line is its bytes, hashed as one long word
    n = len(piece.data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[piece.bounds] = True
    cut[1:] |= np.append(piece.data == 10, True)[:n]
    line_starts = np.flatnonzero(cut[:n])
    line_ends = np.append(line_starts[1:], n)
    ended = (line_ends > line_starts) & (piece.data[np.maximum(line_ends - 1, 0)] == 10) if n else np.zeros(0, bool)
    line_ends = line_ends - ended
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_owner = np.searchsorted(piece.bounds, line_starts, side="right") - 1
    lines = word_hashes(piece, line_starts, line_ends)
    key = mixed(lines + line_owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(lines), dtype=np.int64)
    again[first] = 0
    return {"n_words": counts, "word_chars": piece.sums(letter), "n_symbols": piece.sums(_SYMBOLS[piece.data]),
            "n_dup_lines": np.bincount(line_owner, weights=again, minlength=piece.texts).astype(np.int64),
            "n_repeat_words": spread[edges[1:]] - spread[edges[:-1]]}


def _hashed_rows(labelled: DataFrame, label: str) -> DataFrame:
    """(label, doc_id, sizes, buckets, times) per labelled row: buckets of all kinds one after another, how many each kind has, and how
    often each occurs, in as few bytes as the row's largest count takes."""
    def run(batches):
        for batch in batches:
            for piece in slices(batch.column(1)):
                found = list(features(piece))
                sizes, buckets, times = [], [], []
                for i in range(piece.texts):
                    own = [np.unique(values[edges[i]:edges[i + 1]], return_counts=True) for values, edges in found]
                    counts = np.concatenate([n for _, n in own])
                    sizes.append(np.array([len(n) for _, n in own], dtype=np.int32).tobytes())
                    buckets.append(np.concatenate([v for v, _ in own]).astype(np.uint16).tobytes())
                    times.append(counts.astype(np.min_scalar_type(counts.max(initial=0))).tobytes())
                rows = batch.slice(piece.first, piece.texts)
                yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(0), *[pa.array(x, pa.binary()) for x in (sizes, buckets, times)]],
                                                 names=["label", "doc_id", "sizes", "buckets", "times"])

    return labelled.select("doc_id", "text", F.col(label).cast("int").alias("label")).mapInArrow(
        run, "label int, doc_id long, sizes binary, buckets binary, times binary")


def _bytes(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The bytes of each binary value, in place."""
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, np.uint8, count=int(at[-1])) if data is not None else np.zeros(0, np.uint8)
        yield from (raw[a:b] for a, b in zip(at[:-1], at[1:]))


def _cells(sizes: np.ndarray, buckets: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the weights of all kinds, and the share each has of its kind, of a row of `_hashed_rows`."""
    sizes, buckets = np.frombuffer(sizes.tobytes(), np.int32), np.frombuffer(buckets.tobytes(), np.uint16)
    times = np.frombuffer(times.tobytes(), f"u{len(times) // len(buckets)}") if len(buckets) else np.zeros(0)
    kind = np.repeat(np.arange(len(sizes)), sizes)
    total = np.maximum(np.bincount(kind, weights=times, minlength=len(sizes)), 1)
    return buckets + (kind << BITS), (times / total[kind]).astype(np.float32)


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Newton steps for the probability of label 1 given the margin, with smoothed targets."""
    up, down = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    spread = float(margin.std()) or 1.0
    x = np.stack([(margin - margin.mean()) / spread, np.ones(len(margin))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / spread), float(theta[1] - theta[0] * margin.mean() / spread)


KINDS = 2 + len(_CHARACTERS)


def no_model() -> Model:
    """Keeps everything."""
    return Model(np.zeros((KINDS, 1 << BITS)), 0.0, 0.0, 30.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, epochs: int = 8) -> Model:
    """Fit on at most `max_rows` labelled rows of `max_bytes` in all; every fifth of them, by hash, is left for the calibration."""
    labelled = labelled_rows(docs, labels, label, max_rows, max_bytes)
    rng, table = np.random.default_rng(7), _hashed_rows(labelled, "label").toArrow()
    let_go(docs.sparkSession)  # what Spark collected is in the table now
    found = list(zip(table["label"].to_pylist(), table["doc_id"].to_pylist(), *[_bytes(table[c]) for c in ("sizes", "buckets", "times")]))
    found.sort(key=lambda r: (r[1] is None, r[1], r[0], len(r[3])))
    y = np.array([r[0] for r in found], dtype=float)
    held = np.arange(len(found)) % 5 == 4
    if len(found) < 10 or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return no_model()
    train = np.flatnonzero(~held)
    weigh = np.where(y > 0, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean()))
    w, bias = np.zeros(KINDS << BITS), 0.0
    m, v, m0, v0 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    scale = 16.0  # shares are small; the weights are rescaled at the end

    def margin_of(cells: np.ndarray, shares: np.ndarray) -> float:
        return float(scale * (w[cells] @ shares) + bias)

    for _ in range(epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), 64):
            part = order[at:at + 64]
            rows = [_cells(*found[i][2:]) for i in part]
            push = [(1 / (1 + np.exp(-np.clip(margin_of(*row), -30, 30))) - y[i]) * weigh[i] / len(part) for i, row in zip(part, rows)]
            cells = np.concatenate([c for c, _ in rows])
            values = np.concatenate([scale * p * x for p, (_, x) in zip(push, rows)])
            gradient = np.bincount(cells, weights=values, minlength=len(w))
            m = 0.9 * m + 0.1 * gradient
            v = 0.99 * v + 0.01 * gradient ** 2
            w -= 0.05 * m / (np.sqrt(v) + 1e-4) + 1e-4 * w
            m0, v0 = 0.9 * m0 + 0.1 * sum(push), 0.99 * v0 + 0.01 * sum(push) ** 2
            bias -= 0.05 * m0 / (np.sqrt(v0) + 1e-4)
    tested = np.flatnonzero(held)
    a, b = platt(np.array([margin_of(*_cells(*found[i][2:])) for i in tested]), y[tested])
    del table, found, m, v
    let_go(docs.sparkSession)
    return Model((scale * w).reshape(KINDS, 1 << BITS), bias, a, b)


def probability(margin: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.a * margin + model.b, -60, 60)))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every row. `carry`: other columns to keep, as they are."""
    carry = carry or []
    shared = docs.sparkSession.sparkContext.broadcast(
        Model(model.weights.astype(np.float32), model.intercept, model.a, model.b))  # KINDS * 2 ** BITS numbers

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for piece in slices(batch.column(1)):
                counts = base_counts(piece)
                score = probability(margins(piece, fitted), fitted)
                failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, piece.texts), *[pa.array(counts[c], pa.int64()) for c in _COUNTS],
                     pa.array(failed), pa.array(score, pa.float64()), pa.array(~failed & (score >= threshold)),
                     *[c.slice(piece.first, piece.texts) for c in batch.columns[2:]]],
                    names=["doc_id", *_COUNTS, "base_failed", "score", "kept", *carry])

    made = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("base_failed", T.BooleanType()),
                         T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType()), *[docs.schema[c] for c in carry]])
    return docs.select("doc_id", "text", *carry).mapInArrow(run, made)
