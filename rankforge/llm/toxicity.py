"""Toxicity by a string-subsequence-kernel support vector machine with Nystroem landmarks.

A text is a bag of units: its words in lower case without inner signs (so "i.d.i.o.t" is "idiot"), pieces of long
words, and runs of one- and two-letter words written together ("i d i o t"). The kernel of two units sums over all
common subsequences of three letters, gaps of any size, each weighted by a decay per letter passed over. It is scaled by the
landmark and not by the unit, so a word with letters put in holds nearly all of the word it was, however long it got. Landmarks are
units of the labelled texts; the kernel to them, whitened by the landmarks' own kernel matrix, is a unit's feature vector, and
a linear support vector machine is trained on it, altered copies of the suspects among its rows. Labels are of whole texts: units far more usual in toxic texts are learnt as toxic, each round adds the worst unit of toxic
texts that have none, and clean units that come up as toxic are learnt as clean. A logistic fit on texts left out turns a text's worst
margins, the number of its toxic units and its length into a probability.

The kernel is linear in the landmarks, so their weights fold into one weight per letter triple, and scoring a unit
is a sum over its own triples: exactly the machine's value, without a kernel per landmark.

The fit reads at most `MAX_ROWS` labelled texts, chosen by hash, with at most `MAX_BYTES` in all, whole; of the clean texts' words at most `MAX_CLEAN` distinct
ones, by hash. Both bounds are parameters and hold for the fit alone; every text is scored whole.

Defined results: a null text is the empty text; a text without units counts as one with margins below the machine's intercept, so a low score;
with no labelled texts, or of one kind only, all scores are 0; null labels are not learnt from; several labels or texts of one doc_id count
as texts of their own, equal ones as one; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .labelled import labelled_rows
from .resources import let_go

MAX_ROWS, MAX_BYTES, MAX_CLEAN, LANDMARKS, DECAY, LONGEST = 4000, 24 << 20, 60_000, 240, 0.9, 24
_LIFT, _LEAST = 6.0, 4
_KINDS = 64  # letters are folded into this many
_CACHE = 300_000
_SIGNS = re.compile(r"[\W_]+")
_APART = re.compile(r"(?<!\S)(?:\S{1,2}\s+){2,}\S{1,2}(?!\S)")


def letter_codes() -> dict[str, int]:
    """a-z and 0-9 have codes of their own; look-alike digits and signs are not folded."""
    return {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


_CODES = letter_codes()


def units(text: str) -> set[str]:
    """Distinct units of a text as they stand between white space, before `plain`; runs of short words joined."""
    low = text.lower()
    out = set(low.split())
    for run in _APART.finditer(low):
        out.add("".join(run.group().split()))
    return out


def plain(unit: str) -> list[str]:
    """Letters and digits only, in overlapping pieces of at most `LONGEST`."""
    unit = _SIGNS.sub("", unit)
    if len(unit) <= LONGEST:
        return [unit] if len(unit) >= 3 else []
    step = LONGEST // 2
    return [unit[i:i + LONGEST] for i in range(0, len(unit) - step, step)]


def coded(pieces: list[str]) -> np.ndarray:
    """Codes of the letters, rows padded with 0 to `LONGEST`; other letters share what is left of the codes."""
    flat = np.frombuffer("".join(p.ljust(LONGEST, "\0") for p in pieces).encode("utf-32-le"), dtype="<u4")
    flat = flat.reshape(len(pieces), LONGEST)
    table = np.zeros(128, dtype=np.int64)
    for c, i in _CODES.items():
        table[ord(c)] = i
    first = len(_CODES) + 1
    other = first + (flat.astype(np.int64) * 2654435761 >> 7) % (_KINDS - first)
    return np.where(flat < 128, table[np.minimum(flat, 127)], other)


def features(codes: np.ndarray, decay: float = DECAY) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(rows, triple, weight) for each triple of places i < j < k, over the rows that reach k; the weight is the decay to the
    number of letters between the first and the last that are not among the three."""
    length = (codes > 0).sum(axis=1)
    order = np.argsort(-length, kind="stable")  # rows that reach place k come first
    reach = np.searchsorted(-length[order], -np.arange(LONGEST), side="left")
    placed = np.ascontiguousarray(codes[order].T)
    for k in range(2, LONGEST):
        n = int(reach[k])
        if not n:
            return
        for i in range(k - 1):
            first = placed[i, :n] * (_KINDS * _KINDS) + placed[k, :n]
            weight = decay ** (k - i - 2)
            for j in range(i + 1, k):
                yield order[:n], first + placed[j, :n] * _KINDS, weight


def gram(left: np.ndarray, right: np.ndarray, decay: float = DECAY, strip: int = 500) -> np.ndarray:
    """Kernel of all pairs of units; `strip` left units are worked on at once, so memory follows the strip."""
    def sparse(codes):
        rows, triples, weights = [], [], []
        for r, t, w in features(codes, decay):
            rows.append(r.astype(np.int32))
            triples.append(t.astype(np.int32))
            weights.append(np.full(len(r), w, dtype=np.float32))
        return [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((rows, np.int32), (triples, np.int32), (weights, np.float32))]

    rr, rt, rw = sparse(right)
    seen, number = np.unique(rt, return_inverse=True)
    b = np.bincount(rr.astype(np.int64) * len(seen) + number, weights=rw, minlength=len(right) * len(seen)).astype(np.float32).reshape(len(right), -1)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(seen):
        return out
    strip = max(1, min(strip, (1 << 23) // len(seen)))  # rows whose triples are held as a full matrix
    for s in range(0, len(left), strip):
        lr, lt, lw = sparse(left[s:s + strip])
        at = np.minimum(np.searchsorted(seen, lt), len(seen) - 1)
        hit = seen[at] == lt
        n = min(strip, len(left) - s)
        a = np.bincount(lr[hit].astype(np.int64) * len(seen) + at[hit], weights=lw[hit], minlength=n * len(seen))
        out[s:s + n] = a.astype(np.float32).reshape(n, -1) @ b.T
    return out


def self_norms(codes: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Root of each unit's kernel with itself: equal triples at different places are added up first."""
    out = np.zeros(len(codes))
    found = list(features(codes, decay))
    if not found:
        return out
    rows = np.concatenate([f[0] for f in found])
    triples = np.concatenate([f[1] for f in found])
    weights = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    key = rows * _KINDS ** 3 + triples
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total = np.add.reduceat(weights[order], first)
    return np.sqrt(np.bincount(key[first] // _KINDS ** 3, weights=total ** 2, minlength=len(codes)))


@dataclass
class Model:
    """Weight of each letter triple (the machine over all landmarks), intercept, and the calibration's coefficients."""
    triples: np.ndarray
    intercept: float
    calibration: np.ndarray | None = None
    decay: float = DECAY


def margins(model: Model, pieces: list[str], step: int = 8_000) -> np.ndarray:
    """The machine's value of each unit."""
    out = np.empty(len(pieces))
    weights = model.triples.astype(np.float32)
    for s in range(0, len(pieces), step):
        codes = coded(pieces[s:s + step]).astype(np.int32)
        total = np.zeros(len(codes), dtype=np.float32)
        for rows, triple, weight in features(codes, model.decay):
            total[:len(rows)] += weights[triple] * np.float32(weight)  # rows come longest first, in one order
        length = (codes > 0).sum(axis=1)
        out[s:s + step][np.argsort(-length, kind="stable")] = total
    return out + model.intercept


def altered(unit: str, rng: np.random.Generator) -> list[str]:
    """Copies of a unit with a letter put in, one between every two (two copies), and one left out."""
    letters = [chr(97 + int(x)) for x in rng.integers(0, 26, 2 * len(unit) + 1)]
    a, b = (int(x) for x in rng.integers(1, len(unit), 2))
    apart = [unit[0] + "".join(x + y for x, y in zip(part, unit[1:])) for part in (letters[:len(unit)], letters[len(unit):])]
    return [unit[:a] + letters[-1] + unit[a:], *apart, unit[:b] + unit[b + 1:]]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    z = np.concatenate((x, np.ones((len(x), 1), dtype=x.dtype)), axis=1)
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(min(steps, 30)):
        inside = np.flatnonzero(y * (z @ w.astype(z.dtype)) < 1)
        square, toward = ridge.copy(), np.zeros(z.shape[1])
        for at in range(0, len(inside), 1000):  # rows of a strip in double precision
            rows = inside[at:at + 1000]
            part = z[rows].astype(float)
            weighed = part.T * weight[rows]
            square += 2 * cost * weighed @ part
            toward += 2 * cost * weighed @ y[rows]
        new = np.linalg.solve(square, toward)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def train(texts: list[tuple[int, list[str]]], landmarks: int = LANDMARKS, rounds: int = 5, seed: int = 5,
          max_clean: int = MAX_CLEAN, prior: float | None = None) -> Model | None:
    """texts: (label, units). Every fifth text is left for the calibration, whose odds are moved to those of `prior`.

    Labels may be wrong now and then: a unit is a suspect if it is far more usual in toxic texts (by `_LIFT`, in at
    least `_LEAST` of them), not only if no clean text has it, and a toxic text without any unit near a suspect is left out.
    """
    held = [t for i, t in enumerate(texts) if i % 5 == 4]
    texts = [t for i, t in enumerate(texts) if i % 5 != 4]
    in_toxic, in_clean = Counter(), Counter()
    for y, us in texts:
        (in_toxic if y else in_clean).update(us)
    n_toxic, n_clean = sum(y for y, _ in texts), sum(1 - y for y, _ in texts)
    if not n_toxic or not n_clean or len({y for y, _ in held}) < 2:
        return None
    lift = {p: (n / n_toxic) / ((in_clean[p] + 0.5) / n_clean) for p, n in in_toxic.items()}
    suspects = sorted((p for p, n in in_toxic.items() if n >= _LEAST and lift[p] >= _LIFT), key=lambda p: (-in_toxic[p] * np.log(lift[p]), p))
    clean_list = sorted(p for p in in_clean if lift.get(p, 0) < 3)
    if not suspects or not clean_list:
        return None
    rng = np.random.default_rng(seed)
    if len(clean_list) > max_clean:
        clean_list = [clean_list[i] for i in sorted(rng.choice(len(clean_list), max_clean, replace=False))]
    half = landmarks // 2
    chosen = suspects[:half] + [clean_list[i] for i in rng.choice(len(clean_list), min(half, len(clean_list)), replace=False)]
    marks = coded(chosen)
    square = np.maximum(self_norms(marks) ** 2, 1e-12)
    values, vectors = np.linalg.eigh(gram(marks, marks) / square[:, None] / square[None, :])
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])

    def folded(w: np.ndarray, bias: float) -> Model:
        """The machine is linear in a unit's triples: its weights over the landmarks become weights of triples."""
        per_mark = (whiten @ w) / square
        triples = np.zeros(_KINDS ** 3)
        for rows, t, weight in features(marks):
            np.add.at(triples, t, per_mark[rows] * weight)
        return Model(triples, bias)

    bags = [us for y, us in texts if y and us and not any(lift[p] >= _LIFT and in_toxic[p] >= _LEAST for p in us)]
    known = np.array([np.log(lift[p]) * np.sqrt(in_toxic[p]) for p in suspects])
    sets = [[p for u in altered(s, rng) for p in plain(u)] for s in suspects]
    copies, copied = [p for own in sets for p in own], np.repeat(known, [len(own) for own in sets]) / 4
    extra: Counter = Counter()
    hard = [clean_list[i] for i in rng.choice(len(clean_list), min(4000, len(clean_list)), replace=False)]
    for _ in range(rounds):
        more = sorted(extra)
        x = gram(coded(suspects + copies + more + hard), marks)
        x /= square.astype(np.float32)
        x = x @ whiten.astype(np.float32)
        y = np.concatenate((np.ones(len(suspects) + len(copies) + len(more)), -np.ones(len(hard))))
        usual = np.sqrt([in_clean[p] for p in hard])
        weigh = np.concatenate((known / known.sum(), copied / known.sum(), np.array([extra[p] for p in more]) / (10 * known.sum()), 4 * usual / usual.sum()))
        model = folded(*_svm(x, y, 1000 * weigh))
        value = margins(model, clean_list)
        hard = sorted(set(hard) | {clean_list[i] for i in np.argsort(-value)[:1500]})  # clean units that come up are learnt next
        # toxic texts without a suspect give their worst unit, if it lies on the toxic side
        found = [(us, margins(model, us)) for us in bags]
        extra = Counter(us[int(v.argmax())] for us, v in found if v.max() > 0)
    truth = np.array([float(y) for y, _ in held])
    inputs = np.array([evidence(margins(model, us).tolist() if us else [], model.intercept) for _, us in held])
    model.calibration = _logistic(inputs, truth)
    if prior is not None and 0 < prior < 1:
        model.calibration[-1] += float(np.log(prior / (1 - prior)) - np.log(truth.mean() / (1 - truth.mean())))
    return model


def evidence(values: list[float], least: float) -> tuple[float, ...]:
    """What a text's probability is made of: its two worst margins, cut to -1..1 (`least` where there are fewer), how many
    units are on the toxic side, and how many there are (texts of few units alike)."""
    distinct = sorted(set(values))
    top = [min(1.0, max(v, -1.0)) for v in distinct[:-3:-1]] + [max(least - 1, -1.0)] * 2
    return top[0], top[0] + top[1], float(np.log1p(len(distinct) - bisect(distinct, 0.3))), float(np.log(50 + len(distinct)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients and intercept by Newton steps; inputs are centred and scaled for the ridge."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.concatenate(((x - mean) / spread, np.ones((len(x), 1))), axis=1)
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    theta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ theta)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    out = theta / np.append(spread, 1.0)
    out[-1] -= float((theta[:-1] * mean / spread).sum())
    return out


def probability(model: Model, inputs: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(inputs @ model.calibration[:-1] + model.calibration[-1], -60, 60)))


def _bags(rows: DataFrame) -> DataFrame:
    """(doc_id, label, units joined by line breaks) of the labelled rows."""
    def run(batches):
        for batch in batches:
            texts = [sorted({p for u in units(t or "") for p in plain(u)}) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(["\n".join(t) for t in texts], pa.string())],
                                             names=["doc_id", "label", "units"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(run, "doc_id long, label int, units string")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS,
        max_bytes: int = MAX_BYTES) -> Model | None:
    """Fit on at most `max_rows` labelled rows of `max_bytes` in all, half of both toxic where there are so many."""
    rows = labelled_rows(docs, labels, label, max_rows, max_bytes, each=True, seed=11)
    counts = {r[0]: r[1] for r in labels.select(F.col(label).cast("int").alias("label")).filter("label IS NOT NULL").groupBy("label").count().collect()}
    table = _bags(rows).toArrow()
    found = sorted(zip(*[table[c].to_pylist() for c in ("doc_id", "label", "units")]))
    order = np.random.default_rng(3).permutation(len(found))
    texts = [(found[i][1], list(map(sys.intern, found[i][2].split("\n"))) if found[i][2] else []) for i in order]  # a unit is held once
    del table, found
    let_go(docs.sparkSession)  # what Spark collected is garbage by now
    model = train(texts, landmarks, prior=counts.get(1, 0) / max(1, sum(counts.values())))
    del texts
    let_go(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model | None, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, score, margin) of every row: the probability, and the worst unit's margin. `carry`: other columns to keep, as they are."""
    carry = carry or []
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("margin"), *carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # _KINDS ** 3 numbers

    def run(batches):
        fitted = shared.value
        memory: dict[str, float] = {}
        for batch in batches:
            bags: list[set[str]] = []
            out: list[tuple[float, ...]] = []

            def finish():
                new = list({u for bag in bags for u in bag if u not in memory})
                pieces, owner = [], []
                for i, u in enumerate(new):
                    for p in plain(u):
                        pieces.append(p)
                        owner.append(i)
                value = np.full(len(new), -np.inf)
                if pieces:
                    distinct, number = np.unique(np.array(pieces, dtype=object), return_inverse=True)
                    np.maximum.at(value, np.array(owner), margins(fitted, distinct.tolist())[number])
                memory.update(zip(new, value.tolist()))
                out.extend(evidence([v for v in map(memory.__getitem__, bag) if v > -np.inf], fitted.intercept) for bag in bags)
                bags.clear()
                if len(memory) > _CACHE:
                    memory.clear()

            size = 0
            for text in batch.column(1):
                bags.append(units(text.as_py() or ""))
                size += len(bags[-1])
                if size > 100_000:
                    finish()
                    size = 0
            finish()
            inputs = np.array(out).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(fitted, inputs), pa.float64()), pa.array(inputs[:, 0], pa.float64()),
                                              *batch.columns[2:]], names=["doc_id", "score", "margin", *carry])

    made = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()),
                         *[docs.schema[c] for c in carry]])
    return docs.select("doc_id", "text", *carry).mapInArrow(run, made)


def held_out(doc_id: str) -> Column:
    """Rows labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
