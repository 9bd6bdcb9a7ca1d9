"""Language of texts by a bidirectional gated recurrent network over bytes.

The network labels every byte position of a text with a distribution over the learned languages
and a document gets the mean of its positions. Gates and candidate state use the piecewise linear
forms of sigmoid and tanh, which cost a fraction of the exponential ones. Training is plain back-propagation through time in numpy on a bounded
sample of windows; scoring runs over every byte of every text in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcast.llm.base import id_remainder, map_slices, ramp, text_bytes

HIDDEN = 8
WINDOW = 256  # bytes read with one pair of states
LANES = 4096  # windows read side by side
TRAIN_WINDOW = 96
TRAIN_WINDOWS = 6000  # bound of the training sample, shared out evenly among the languages
UNKNOWN = "und"


@dataclass
class GatedNet:
    """Weights; rows of a table are update, reset and candidate inputs of each byte."""

    labels: list[str]
    tables: np.ndarray  # (2, 3H, 256)
    recur: np.ndarray  # (2, 3H, H)
    out: np.ndarray  # (2, C, H)
    bias: np.ndarray  # (C, 1)


def _start(labels: list[str], seed: int) -> GatedNet:
    rng = np.random.default_rng(seed)
    h, c = HIDDEN, len(labels)
    tables = rng.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32)
    recur = rng.normal(0, 0.3, (2, 3 * h, h)).astype(np.float32)
    out = rng.normal(0, 0.3, (2, c, h)).astype(np.float32)
    return GatedNet(labels, tables, recur, out, np.zeros((c, 1), np.float32))


def _gradients(net: GatedNet, x: np.ndarray, y: np.ndarray):
    """Loss and gradients for windows ``x`` (T, B) of one length with one-hot languages ``y`` (C, B)."""
    steps, lanes = x.shape
    h = HIDDEN
    saved = [[None] * steps, [None] * steps]
    states = np.zeros((2, steps, h, lanes), np.float32)
    for d in (0, 1):
        state = np.zeros((h, lanes), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            given = net.tables[d][:, x[t]]
            back = net.recur[d] @ state
            raw = 0.25 * (given[: 2 * h] + back[: 2 * h]) + 0.5
            gates = np.clip(raw, 0, 1)
            full = given[2 * h:] + gates[h:] * back[2 * h:]
            cand = np.clip(full, -1, 1)
            saved[d][t] = (state, gates, (raw > 0) & (raw < 1), cand, np.abs(full) < 1, back[2 * h:])
            state = state + gates[:h] * (cand - state)
            states[d, t] = state
    logits = np.matmul(net.out[0], states[0]) + np.matmul(net.out[1], states[1]) + net.bias
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    loss = float(-np.log((p * y).sum(1) + 1e-9).mean())
    slope = (p - y) / (steps * lanes)
    grads = GatedNet(net.labels, np.zeros_like(net.tables), np.zeros_like(net.recur),
                     np.einsum("tcb,dthb->dch", slope, states, optimize=True), slope.sum((0, 2))[:, None])
    for d in (0, 1):
        carried = np.zeros((h, lanes), np.float32)
        inputs = np.zeros((steps, 3 * h, lanes), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            state, gates, open_, cand, free, back = saved[d][t]
            ds = carried + net.out[d].T @ slope[t]
            dcand = ds * gates[:h] * free
            dgate = np.concatenate([ds * (cand - state), dcand * back]) * open_ * 0.25
            dback = np.concatenate([dgate, dcand * gates[h:]])
            carried = ds * (1 - gates[:h]) + net.recur[d].T @ dback
            grads.recur[d] += dback @ state.T
            inputs[t, : 2 * h], inputs[t, 2 * h:] = dgate, dcand
        flat = inputs.transpose(1, 0, 2).reshape(3 * h, -1)
        for row in range(3 * h):
            grads.tables[d, row] = np.bincount(x.ravel(), flat[row], 256)
    return loss, grads


def fit(windows: list[bytes], langs: list[str], steps: int = 110, batch: int = 256, seed: int = 7) -> GatedNet:
    """Train on byte windows by Adam; windows shorter than the training length are repeated."""
    labels = sorted(set(langs))
    net = _start(labels, seed)
    if len(labels) < 2:
        return net
    x = np.array([np.resize(np.frombuffer(w, np.uint8), TRAIN_WINDOW) for w in windows])
    y = np.array([labels.index(lang) for lang in langs])
    parts = ("tables", "recur", "out", "bias")
    mean = {k: np.zeros_like(getattr(net, k)) for k in parts}
    square = {k: np.zeros_like(getattr(net, k)) for k in parts}
    rng = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        one_hot = (np.arange(len(labels))[:, None] == y[pick]).astype(np.float32)
        _, grads = _gradients(net, np.ascontiguousarray(x[pick].T), one_hot)
        rate = 0.03 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k in parts:
            g = getattr(grads, k)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            change = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            setattr(net, k, (getattr(net, k) - rate * change).astype(np.float32))
    return net


def _read_windows(net: GatedNet, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of position distributions per window (C, B); sizes must not grow."""
    h, c, steps = HIDDEN, len(net.labels), int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # windows longer than t
    letters = raw[np.minimum(starts[:, None] + np.arange(steps), len(raw) - 1)].T.astype(np.int64, "C")
    tables, recur = net.tables.copy(), net.recur.copy()
    tables[:, : 2 * h] = 0.25 * tables[:, : 2 * h] + 0.5
    recur[:, : 2 * h] *= 0.25
    ahead = np.empty((steps, c, len(starts)), np.float32)
    total = np.zeros((c, len(starts)), np.float32)
    for d in (0, 1):
        state = np.zeros((h, len(starts)), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            n = active[t]
            now = state[:, :n]
            given = np.take(tables[d], letters[t, :n], axis=1, mode="clip")
            back = recur[d] @ now
            gates = back[: 2 * h]
            gates += given[: 2 * h]
            np.clip(gates, 0, 1, out=gates)
            cand = back[2 * h:]
            cand *= gates[h:]
            cand += given[2 * h:]
            np.clip(cand, -1, 1, out=cand)
            cand -= now
            cand *= gates[:h]
            now += cand
            scores = net.out[d] @ now
            if d == 0:
                np.add(scores, net.bias, out=ahead[t, :, :n])
            else:
                scores += ahead[t, :, :n]
                np.exp(scores, out=scores)  # states are within -1 and 1, so this stays finite
                scores /= scores.sum(0)
                total[:, :n] += scores
    return total


def document_probabilities(net: GatedNet, column: pa.Array) -> np.ndarray:
    """(documents, languages): mean distribution over the byte positions; zero for an empty text."""
    raw, offsets = text_bytes(column)
    lengths = np.diff(offsets)
    pieces = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    starts = offsets[:-1][owner] + ramp(pieces) * WINDOW
    sizes = np.minimum(WINDOW, offsets[1:][owner] - starts)
    order = np.argsort(-sizes, kind="stable")
    sums = np.zeros((len(lengths), len(net.labels)))
    for at in range(0, len(order), LANES):
        lanes = order[at:at + LANES]
        found = _read_windows(net, raw, starts[lanes], sizes[lanes])
        for label in range(len(net.labels)):
            sums[:, label] += np.bincount(owner[lanes], found[label], len(lengths))
    return sums / np.maximum(lengths, 1)[:, None]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = TRAIN_WINDOWS) -> GatedNet:
    """Fit on at most about ``sample`` windows of the labelled rows given.

    Every language gets the same share; rows are taken by a hash of the text, one window from a
    hashed place in each; texts that repeat under one language count once. Rows without a language or a letter are left out. Without any
    language the net has no label and every text is undetermined.
    """
    good = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h"))
    counts = {r["lang"]: r["count"] for r in good.groupBy("lang").count().collect()}
    if not counts:
        return GatedNet([], *[np.zeros(0, np.float32)] * 4)
    share = sample // len(counts)
    rate = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, share / n))])
    width = 4 * TRAIN_WINDOW
    place = F.pmod(F.shiftright("h", 32), F.greatest(F.length("text") - TRAIN_WINDOW, F.lit(0)) + 1).cast("int")
    picked = good.filter(F.pmod("h", F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30)).select(
        F.substring("text", place + 1, F.lit(TRAIN_WINDOW)).alias("w"), "lang", "h")
    once = picked.groupBy("h", "lang").agg(F.min("w").alias("w")).orderBy("h", "lang")
    rows = once.limit(2 * sample + width).collect()
    return fit([r["w"].encode()[:TRAIN_WINDOW] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, net: GatedNet, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended (columns of these names are replaced).

    Null texts and texts without a letter get ``und`` and score 0. Empty tables give no rows.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_letter")]
    named = docs.select(*kept, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    schema = named.drop("_letter").schema.add("lang_pred", "string").add("score", "double")

    def make():
        names = np.array([*net.labels, UNKNOWN], dtype=object)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            letter = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            if net.labels:
                p = document_probabilities(net, batch.column(text))
                best, top = p.argmax(1), np.clip(p.max(1), 0, 1)
            else:
                best, top = np.zeros(len(letter), int), np.zeros(len(letter))
                letter = letter & False
            best = np.where(letter, best, len(names) - 1)
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array(names[best], pa.string()), pa.array(np.where(letter, top, 0.0))]
            return pa.RecordBatch.from_arrays(arrays, names=[*kept, "lang_pred", "score"])

        return work

    return map_slices(named, text, make, schema)


def held_out(doc_id: str = "doc_id"):
    """Documents kept from training: crc32 of the id modulo 5 is 0."""
    return id_remainder(F.col(doc_id), 5) == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from the others' text and lang."""
    net = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
