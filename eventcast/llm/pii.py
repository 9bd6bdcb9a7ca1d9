"""Personal data in texts: fixed patterns, and a character network with transition scores.

A bidirectional long short-term memory network over characters gives every character of a window
a score per tag; a linear-chain conditional random field decodes the best tag path. It is trained
in numpy from labelled spans. Texts are read in overlapping windows, and the windows' spans are
reconciled over the whole text: where windows disagree, the one in which the span lies deepest
decides, and base spans always stay.

A span of any kind holds a digit or an @ by the definition of the kinds; windows without either
decode to no span under that constraint and are not run through the network.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcast.llm.base import joined_spans, map_slices

# Kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")

HIDDEN = 12
WINDOW = 96  # characters read with one pair of states
STRIDE = 48
LANES = 1024
TRAIN_DOCS = 2000  # bound of the documents whose windows are labelled for training
TAGS = 1 + 2 * len(KINDS)  # outside, then first and further characters of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: every @ takes the whole run of local characters before it, back to the
    end of the match before, which is where a scan from the left would start."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; matches that fail their test are dropped."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    if not ANCHOR.search(text):
        return spans
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return spans


@dataclass
class TagNet:
    """Weights; gates of a step are in the order input, forget, output, candidate."""

    letters: np.ndarray  # (2, 4H, SYMBOLS)
    recur: np.ndarray  # (2, 4H, H)
    out: np.ndarray  # (2, TAGS, H)
    bias: np.ndarray  # (TAGS, 1)
    moves: np.ndarray  # (TAGS, TAGS), from row to column


SYMBOLS = 98  # printable ASCII, blank kinds, other letters, other signs


def encode(text: str) -> np.ndarray:
    """Symbol of each character: 0-94 printable ASCII, 95 blanks, 96 other characters, 97 outside."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    printable = (codes >= 33) & (codes < 127)
    return np.where(printable, codes - 32, np.where(codes < 33, 95, 96))


def allowed_moves() -> np.ndarray:
    """Penalty of tag paths that no span has: a further character only after its own kind."""
    cost = np.zeros((TAGS, TAGS), np.float32)
    for kind in range(len(KINDS)):
        further = 2 + 2 * kind
        cost[:, further] = -1e4
        cost[[further - 1, further], further] = 0
    return cost


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(net: TagNet, x: np.ndarray, keep: bool):
    """Tag scores (T, TAGS, B) of windows (T, B), and what back-propagation needs."""
    steps, lanes = x.shape
    h = HIDDEN
    states = np.zeros((2, steps, h, lanes), np.float32)
    saved = [[None] * steps, [None] * steps]
    for d in (0, 1):
        state, cell = np.zeros((h, lanes), np.float32), np.zeros((h, lanes), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            raw = np.take(net.letters[d], x[t], axis=1) + net.recur[d] @ state
            gates, cand = _sigmoid(raw[: 3 * h]), np.tanh(raw[3 * h:])
            before, old = state, cell
            cell = gates[h: 2 * h] * old + gates[:h] * cand
            open_ = np.tanh(cell)
            state = gates[2 * h:] * open_
            states[d, t] = state
            if keep:
                saved[d][t] = (before, old, gates, cand, open_)
    scores = np.matmul(net.out[0], states[0]) + np.matmul(net.out[1], states[1]) + net.bias
    return scores, states, saved


def _chain(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray):
    """Mean negative log likelihood of the tag paths, its slope by score and by move."""
    steps, _, lanes = scores.shape
    ahead = np.empty_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        step = ahead[t - 1][:, None, :] + moves[:, :, None]
        top = step.max(0)
        ahead[t] = scores[t] + top + np.log(np.exp(step - top).sum(0))
    top = ahead[-1].max(0)
    norm = top + np.log(np.exp(ahead[-1] - top).sum(0))
    behind = np.zeros_like(scores)
    move_slope = np.zeros_like(moves)
    for t in range(steps - 2, -1, -1):
        after = scores[t + 1] + behind[t + 1]
        step = moves[:, :, None] + after[None]
        top = step.max(1)
        behind[t] = top + np.log(np.exp(step - top[:, None]).sum(1))
        move_slope += np.exp(ahead[t][:, None, :] + step - norm).sum(2)
    slope = np.exp(ahead + behind - norm)
    lane = np.arange(lanes)
    path = np.zeros(lanes)
    for t in range(steps):
        slope[t, tags[t], lane] -= 1
        path += scores[t, tags[t], lane]
        if t:
            path += moves[tags[t - 1], tags[t]]
            np.subtract.at(move_slope, (tags[t - 1], tags[t]), 1)
    return float((norm - path).mean()), slope / lanes, move_slope / lanes


def _gradients(net: TagNet, x: np.ndarray, tags: np.ndarray):
    steps, lanes = x.shape
    h = HIDDEN
    scores, states, saved = _forward(net, x, True)
    loss, slope, move_slope = _chain(scores, net.moves, tags)
    slope = slope.astype(np.float32)
    grads = TagNet(np.zeros_like(net.letters), np.zeros_like(net.recur),
                   np.einsum("tcb,dthb->dch", slope, states, optimize=True), slope.sum((0, 2))[:, None], move_slope)
    for d in (0, 1):
        dstate, dcell = np.zeros((h, lanes), np.float32), np.zeros((h, lanes), np.float32)
        inputs = np.empty((steps, 4 * h, lanes), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            before, old, gates, cand, open_ = saved[d][t]
            dstate = dstate + net.out[d].T @ slope[t]
            dcell = dcell + dstate * gates[2 * h:] * (1 - open_ * open_)
            dgate = np.concatenate([dcell * cand, dcell * old, dstate * open_]) * gates * (1 - gates)
            inputs[t, : 3 * h], inputs[t, 3 * h:] = dgate, dcell * gates[:h] * (1 - cand * cand)
            grads.recur[d] += inputs[t] @ before.T
            dstate = net.recur[d].T @ inputs[t]
            dcell = dcell * gates[h: 2 * h]
        flat = inputs.transpose(1, 0, 2).reshape(4 * h, -1)
        for row in range(4 * h):
            grads.letters[d, row] = np.bincount(x.ravel(), flat[row], SYMBOLS)
    return loss, grads


def fit(windows: list[np.ndarray], tags: list[np.ndarray], steps: int = 120, batch: int = 96, seed: int = 5) -> TagNet:
    """Train on windows of symbols with a tag per character by Adam."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    net = TagNet(rng.normal(0, 0.3, (2, 4 * h, SYMBOLS)).astype(np.float32),
                 rng.normal(0, 0.25, (2, 4 * h, h)).astype(np.float32),
                 rng.normal(0, 0.3, (2, TAGS, h)).astype(np.float32), np.zeros((TAGS, 1), np.float32),
                 np.zeros((TAGS, TAGS), np.float32))
    x, y = np.array(windows), np.array(tags)
    fixed = allowed_moves()
    net.moves += fixed
    parts = ("letters", "recur", "out", "bias", "moves")
    mean = {k: np.zeros_like(getattr(net, k)) for k in parts}
    square = {k: np.zeros_like(getattr(net, k)) for k in parts}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        _, grads = _gradients(net, np.ascontiguousarray(x[pick].T), np.ascontiguousarray(y[pick].T))
        rate = 0.03 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k in parts:
            g = np.clip(getattr(grads, k), -5, 5)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            change = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            setattr(net, k, (getattr(net, k) - rate * change).astype(np.float32))
        net.moves = np.where(fixed < 0, fixed, net.moves)
    return net


def decode(net: TagNet, x: np.ndarray) -> np.ndarray:
    """Best tag path (T, B) of windows (T, B)."""
    scores, _, _ = _forward(net, x, False)
    steps, _, lanes = scores.shape
    best = scores[0]
    source = np.zeros((steps, TAGS, lanes), np.int8)
    for t in range(1, steps):
        step = best[:, None, :] + net.moves[:, :, None]
        source[t] = step.argmax(0)
        best = scores[t] + step.max(0)
    path = np.empty((steps, lanes), np.int8)
    path[-1] = best.argmax(0)
    lane = np.arange(lanes)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = source[t][path[t], lane]
    return path


def _made_span(rng: np.random.Generator) -> tuple[int, str]:
    """A kind with a made value, in forms inside and outside the fixed patterns; -1 for look-alikes."""
    n = lambda k: "".join(str(rng.integers(10)) for _ in range(k))
    word = lambda: "".join(chr(97 + rng.integers(26)) for _ in range(rng.integers(2, 9)))
    form = rng.integers(15)
    if form < 2:
        return 0, f"{word()}{'.' if form else '_'}{n(rng.integers(0, 4))}@{word()}{n(rng.integers(0, 2))}.{word()[:3]}.com"
    if form < 4:
        return 1, ".".join(str(rng.integers(256)) for _ in range(4))
    if form < 7:
        digits = str(rng.integers(3, 7)) + n(14)
        check = next(str(c) for c in range(10) if luhn(digits + str(c)))
        digits += check
        sep = ("", " ", ".")[form - 4]
        return 2, sep.join(digits[i:i + 4] for i in range(0, 16, 4))
    if form < 11:
        return 3, (f"+{rng.integers(1, 99)} ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}",
                   f"+{rng.integers(1, 99)}-{n(3)}-{n(7)}", f"00{rng.integers(1, 99)} {n(3)} {n(7)}")[form - 7]
    if form == 11:
        return -1, f"{rng.integers(1, 20)}.{rng.integers(0, 20)}"
    if form == 12:
        return -1, str(rng.integers(1, 10**rng.integers(1, 12)))
    if form == 13:
        return -1, f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    return -1, "".join("0123456789abcdef"[rng.integers(16)] for _ in range(40))


def labelled_windows(texts: list[str], count: int = 3000, seed: int = 3):
    """Windows with tags: base spans of the texts themselves, and made values set between their words."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t.strip()] or ["the and of to in is was for on with"]
    windows, tags = [], []
    while len(windows) < count:
        text = texts[rng.integers(len(texts))]
        kind, value = _made_span(rng)
        anchors = [m.start() for m in ANCHOR.finditer(text)] if rng.random() < 0.4 else []
        if anchors:  # a place of the text's own
            at = anchors[rng.integers(len(anchors))]
            start = max(0, at - int(rng.integers(WINDOW)))
            part = text[max(0, start - WINDOW): start + 2 * WINDOW]
            cut = min(start, WINDOW)
        else:
            at = int(rng.integers(len(text)))
            at = text.find(" ", at) + 1
            part = text[max(0, at - 2 * WINDOW): at] + value + (" " if rng.random() < 0.8 else ". ") + text[at: at + WINDOW]
            cut = max(0, min(at, 2 * WINDOW) - int(rng.integers(WINDOW - 8)))
        y = np.zeros(len(part) + WINDOW, np.int64)
        for s, k, e in base_spans(part):
            y[s], y[s + 1: e] = 1 + 2 * k, 2 + 2 * k
        if not anchors and kind >= 0:
            s = min(at, 2 * WINDOW)
            y[s], y[s + 1: s + len(value)] = 1 + 2 * kind, 2 + 2 * kind
        x = np.full(len(part) + WINDOW, 97)
        x[: len(part)] = encode(part)
        x, y = x[cut: cut + WINDOW], y[cut: cut + WINDOW].copy()
        if y[0] and y[0] % 2 == 0:
            y[0] -= 1  # a span cut by the window's edge begins there
        windows.append(x)
        tags.append(y)
    return windows, tags


def proper(text: str, start: int, kind: int, end: int) -> bool:
    """Whether a decoded span can be one of its kind at all; keeps the network to whole values."""
    value = text[start:end]
    digits = "".join(c for c in value if c in "0123456789")
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return False
    if kind == 0:
        at = value.find("@")
        return 0 < at and "." in value[at + 2:]
    if kind == 1:
        parts = value.split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    if not re.fullmatch(r"[+(]?[0-9][0-9\x20().\-/]*[0-9]", value):
        return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(digits) < len(value)


def network_spans(net: TagNet, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans the network finds in each text, reconciled over its windows."""
    codes, places = [], []
    for i, text in enumerate(texts):
        wanted = sorted({w for m in ANCHOR.finditer(text)
                         for w in range(max(0, (m.start() - WINDOW) // STRIDE + 1), m.start() // STRIDE + 1)})
        if wanted:
            symbols = encode(text)
            for w in wanted:
                window = np.full(WINDOW, 97)
                part = symbols[w * STRIDE: w * STRIDE + WINDOW]
                window[: len(part)] = part
                codes.append(window)
                places.append((i, w * STRIDE))
    found: list[dict] = [{} for _ in texts]
    for at in range(0, len(codes), LANES):
        paths = decode(net, np.ascontiguousarray(np.array(codes[at:at + LANES]).T)).T
        for (i, shift), path in zip(places[at:at + LANES], paths):
            for first in np.flatnonzero(path % 2 == 1):
                end = first + 1
                while end < WINDOW and path[end] == path[first] + 1:
                    end += 1
                depth = min(first if shift else WINDOW, WINDOW - end)
                key = (shift + int(first), (int(path[first]) - 1) // 2, shift + int(end))
                found[i][key] = max(depth, found[i].get(key, -1))
    out = []
    for text, spans in zip(texts, found):
        kept: list[tuple[int, int, int]] = []
        for (start, kind, end), _ in sorted(spans.items(), key=lambda s: (-s[1], s[0])):
            end = min(end, len(text))
            if proper(text, start, kind, end) and all(e <= start or end <= s for s, _, e in kept):
                kept.append((start, kind, end))
        out.append(kept)
    return out


def find_personal(net: TagNet | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; the network adds spans that overlap no base span."""
    extra = network_spans(net, texts) if net else [[] for _ in texts]
    out = []
    for text, more in zip(texts, extra):
        base = base_spans(text)
        out.append((base, base + [m for m in more if all(e <= m[0] or m[2] <= s for s, _, e in base)]))
    return out


def train(docs: DataFrame, text: str = "text", sample: int = TRAIN_DOCS) -> TagNet:
    """Fit on windows of about ``sample`` documents at most: half with a digit or @, half of any kind,
    taken by a hash of the text, and of each one stretch around a hashed place. Texts that repeat count once."""
    rows = docs.filter(F.length(text) > 0).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    digit = F.regexp_instr("t", F.lit("[0-9@]"))
    rows = rows.withColumn("at", digit).withColumn("marked", F.col("at") > 0)
    counts = {r["marked"]: r["count"] for r in rows.groupBy("marked").count().collect()}
    rate = F.lit(0.0)
    for marked, n in counts.items():
        rate = F.when(F.col("marked") == marked, min(1.0, sample / 2 / n)).otherwise(rate)
    place = F.when(F.col("marked"), F.col("at")).otherwise(F.pmod(F.shiftright("h", 32), F.length("t")).cast("int"))
    picked = rows.filter(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30)).select(
        F.substring("t", F.greatest(place - 3 * WINDOW, F.lit(1)), F.lit(6 * WINDOW)).alias("t"), "h")
    texts = [r["t"] for r in picked.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(2 * sample).collect()]
    return fit(*labelled_windows(texts))


def scan(docs: DataFrame, net: TagNet | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans as text.

    A null text is an empty one without spans; repeated rows give repeated results; other columns are
    not read. The network is trained on the documents unless one is given.
    """
    net = net or train(docs, text)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = (f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
              "spans string, n_added long")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, spans, added = [[], [], [], []], [], [], []
            for base, every in find_personal(net, [v or "" for v in batch.column("text").to_pylist()]):
                for k in range(4):
                    counts[k].append(sum(1 for s in base if s[1] == k))
                digests.append(hashlib.sha256(joined_spans(base, KINDS).encode()).hexdigest())
                spans.append(joined_spans(every, KINDS))
                added.append(len(every) - len(base))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests),
                 pa.array(spans), pa.array(added, pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

        return work

    return map_slices(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "text", make, schema)


def redact(docs: DataFrame, net: TagNet | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; all other columns as they are.

    Overlapping spans become one mark named after the first. Null texts stay null.
    """
    net = net or train(docs, text)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = batch.column(text).to_pylist()
            out = []
            for value, (_, spans) in zip(values, find_personal(net, [v or "" for v in values])):
                pieces, done = [], 0
                for start, kind, end in sorted(spans):
                    if start >= done:
                        pieces += [value[done:start], f"<{KINDS[kind].upper()}>"]
                    done = max(done, end)
                out.append("".join([*pieces, value[done:]]) if spans else value)
            at = batch.schema.get_field_index(text)
            return batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

        return work

    return map_slices(docs, text, make, docs.schema)
