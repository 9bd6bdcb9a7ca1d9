"""Removal of every byte covered by a long string that starts more than once in the corpus.

Every window of ``length`` bytes is assigned to its anchor, the leftmost gram inside it whose hash is least in its upper bits.
Equal windows have equal anchors at the same place, so only texts around anchors that occur more than once can
hold repeats, and neighbouring windows with one anchor form a segment:

1. Equal segments are counted; all their windows repeat, whatever the number of copies.
2. Different segments with equal anchor grams go to one shard. A shard sorts its suffixes by the
   Larsson-Sadakane refinement to the length of a window; windows of equal rank are those that repeat in it.
3. Anchors with very many different segments are split over shards. These send the sorted
   fingerprints of their distinct windows, cut at fixed splitters, to merge tasks, which find windows
   of several shards by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcast.llm.base import map_slices, numbered, ramp, text_bytes
from eventcast.session import stage_table

LENGTH = 400
GRAM = 64
CHUNK = 1 << 18  # window starts looked at together
SHARD_BYTES = 2 << 20
SPLIT_KINDS = 2000  # different segments of one anchor in one shard
MERGE_WINDOWS = 1 << 20  # window fingerprints per merge task
HOT_SHARE = 1000  # keys with at least this part of all rows are met by broadcast, so at most as many
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.uint64((1 << 22) - 1)  # low bits of a hash that hold a place in a part of CHUNK window starts


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on; GRAM is a power of two."""
    h = raw.astype(np.uint64) * MIX
    width = 1
    while width < GRAM:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(31))) * MIX + h[width:]
        width *= 2
    return (h ^ (h >> np.uint64(29))) * MIX


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, from running minima inside blocks of that width."""
    size = len(values)
    padded = np.full(-(-size // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:size] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: size - width + 1], before[width - 1: size])


def segments_of(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Segments of all documents in a buffer: (document, start, windows, lead, anchor hash, content hash).

    ``start`` counts from the document's begin; ``lead`` is the way from it to the anchor.
    """
    width = length - GRAM + 1
    content = raw.tobytes()
    digest = xxhash.xxh3_64_intdigest
    out: list[tuple[np.ndarray, ...]] = []
    for low in range(0, max(0, len(raw) - length + 1), CHUNK):
        part = raw[low:low + CHUNK + length - 1]
        if len(part) < length:
            break
        h = gram_hashes(part)
        # The place in the part takes the low bits, so the least value names its gram, the leftmost of equal ones.
        least = sliding_least(h & ~PLACES | np.arange(len(h), dtype=np.uint64), width)
        n = len(least)
        first, last = np.searchsorted(offsets, [low, low + n - 1], side="right") - 1
        ends = np.minimum(offsets[first + 1:last + 2], low + n)
        doc = np.repeat(np.arange(first, last + 1), np.diff(np.append(low, ends)))
        valid = np.arange(low, low + n) + length <= offsets[doc + 1]
        anchor = (least & PLACES).astype(np.int64)
        change = np.ones(n, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
        begins = np.flatnonzero(change)
        windows = np.diff(np.append(begins, n))
        good = valid[begins]
        begins, windows = begins[good], windows[good]
        hashes = [digest(content[s:e]) for s, e in
                  zip((low + begins).tolist(), (low + begins + windows + length - 1).tolist())]
        out.append((doc[begins], low + begins - offsets[doc[begins]], windows, anchor[begins] - begins,
                    h[anchor[begins]].view(np.int64), np.array(hashes, np.uint64).view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*out))


def ranked_suffixes(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` bytes, the rank of each, and the eight bytes at each position as one word.

    Larsson-Sadakane: the order by eight bytes is refined by doubling, with the ranks found so far as
    keys; groups that are sorted already are left alone. The last step goes only as far as ``depth``, so
    two suffixes of at least that length have one rank if and only if their first ``depth`` bytes are equal.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(depth + 16, np.uint8)])
    word = padded.astype(np.uint64)
    for width in (1, 2, 4):
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
    reach = min(8, depth)
    first_bytes = word[:n] >> np.uint64(8 * (8 - reach))
    order = np.argsort(first_bytes)
    ordered = first_bytes[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n + depth + 1, np.int64)
    rank[n:] = -1
    rank[order] = np.repeat(first, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while reach < depth and len(slots):
        step = min(reach, depth - reach)
        suffix = order[slots]
        key = rank[suffix] * (n + 1) + rank[suffix + step] + 1
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[slots] = suffix
        begins = np.ones(len(slots), bool)
        begins[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(begins)
        sizes = np.diff(np.append(heads, len(slots)))
        rank[suffix] = np.repeat(slots[heads], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        reach += step
    return order, rank[:n], word


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` bytes, and the eight bytes at each position as one word."""
    order, _, word = ranked_suffixes(raw, depth)
    return order, word


def common_prefixes(order: np.ndarray, word: np.ndarray, begins: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, at most ``depth``.

    Kasai's walk: going one position right loses at most one byte, unless the two are equal over ``depth`` bytes: then
    the order does not tell them apart, those right of them may lie either way round, and the walk starts anew. One
    walk runs per stretch of text, all stretches in step, and compares eight bytes at a time.
    """
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    found = np.zeros(n, np.int64)
    sizes = np.diff(np.append(begins, n))
    by_size = np.argsort(-sizes, kind="stable")
    lanes, sizes = begins[by_size], sizes[by_size]
    running = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
    height = np.zeros(len(lanes), np.int64)
    for t, count in enumerate(running.tolist()):
        at = lanes[:count] + t
        other = before[at]
        h = np.where(other >= 0, np.maximum(height[:count] - 1, 0), depth)
        open_ = np.flatnonzero(h < depth)
        while len(open_):
            far = h[open_]
            x = word[at[open_] + far] ^ word[other[open_] + far]
            top = np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1]  # bit length, never rounded up
            same = (64 - top) // 8
            h[open_] = np.minimum(far + same, depth)
            open_ = open_[(same == 8) & (h[open_] < depth)]
        h[other < 0] = 0
        found[at] = h
        height[:count] = np.where(h < depth, h, 0)
    return found[order]


def shard_repeats(contents: list[bytes], windows: np.ndarray, length: int):
    """Windows of a shard's segments in suffix order: (segment, start in it, class number, class size).

    Windows of one class are equal.
    """
    raw = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents], np.int64)
    order, rank, _ = ranked_suffixes(raw, length)
    owner = np.repeat(np.arange(len(contents)), sizes)
    at = ramp(sizes)
    chosen = order[(at < windows[owner])[order]]
    classes = rank[chosen]
    number = np.cumsum(np.append(False, classes[1:] != classes[:-1]))
    return owner[chosen], at[chosen], number, np.bincount(number)[number]


def runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, count) of maximal runs of neighbouring starts."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], start[last] - start[first] + 1


Run = tuple[np.ndarray, np.ndarray, np.ndarray]  # fingerprints (two words, ordered) and a reference of each


def merge_two(a: Run, b: Run, hit: list[np.ndarray]) -> Run:
    """One sorted run of both; references of windows that both have are added to ``hit``."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    at = np.searchsorted(a[0], b[0])
    inside = np.minimum(at, max(len(a[0]) - 1, 0))
    same = (a[0][inside] == b[0]) & (a[1][inside] == b[1]) if len(a[0]) else np.zeros(len(b[0]), bool)
    hit += [a[2][inside[same]], b[2][same]]
    rest = ~same
    return tuple(np.insert(x, at[rest], y[rest]) for x, y in zip(a, b))


def anchored(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Written table of the segments of numbered documents (_row, text)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, offsets = text_bytes(batch.column("text"))
            doc, start, windows, lead, key, seg = segments_of(raw, offsets, length)
            return pa.RecordBatch.from_arrays(
                [batch.column("_row").take(pa.array(doc)), pa.array(start), pa.array(windows.astype(np.int32)),
                 pa.array(lead.astype(np.int32)), pa.array(key), pa.array(seg)],
                names=["row", "start", "n", "lead", "key", "seg"])

        return work

    return stage_table(map_slices(docs.select("_row", "text"), "text", make,
                                  "row long, start long, n int, lead int, key long, seg long"))


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` segments with their bytes, cut from the texts of their rows."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "copies", "parts", "sub", "start", "n")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "copies", "parts", "sub", "start", "n")
        for batch in batches:
            for row, text, cuts in zip(*(batch.column(c) for c in ("row", "text", "cuts"))):
                raw, cuts = (text.as_py() or "").encode(), cuts.as_py()
                for at in range(0, len(cuts), 1024):
                    some = cuts[at:at + 1024]
                    columns = {c: pa.array([x[c] for x in some], pa.int64()) for c in names}
                    content = [raw[x["start"]: x["start"] + x["n"] + length - 1] for x in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row.as_py()] * len(some), pa.int64()), *columns.values(), pa.array(content, pa.binary())],
                        names=["row", *names, "content"])

    texts = docs.select(F.col("_row").alias("row"), "text")
    return texts.join(lists, "row").select("row", "text", "cuts").mapInArrow(
        cut, "row long, key long, copies long, parts long, sub long, start long, n long, content binary")


def meet(rows: DataFrame, counted: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` whose key is in ``counted`` (unique keys with their number of rows), with its columns.

    Keys with at least 1/HOT_SHARE of all ``total`` rows are broadcast, at most HOT_SHARE of them, so that their
    rows stay where they are; only the rows of other keys are shuffled. Both tables are read twice and should
    be written ones.
    """
    hot = F.broadcast(counted.filter(F.col(count) * HOT_SHARE >= total))
    light = rows.join(hot.select(*on), on, "left_anti").join(counted, on)
    return rows.join(hot, on).unionByName(light)


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, start, n): runs of window starts that repeat, for numbered documents (_row, text)."""
    found = anchored(docs, length)
    same = ["key", "seg", "n", "lead"]
    groups = stage_table(found.groupBy(*same).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start")).alias("first")))
    totals = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    copied = groups.filter("copies > 1").select(*same, "copies")
    marks = meet(found, copied, same, "copies", totals["rows"]).select("row", "start", F.col("n").cast("long").alias("n"))

    mixed = stage_table(groups.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    parts = F.ceil(F.col("kinds") / SPLIT_KINDS)
    wanted = stage_table(meet(groups, mixed, ["key"], "kinds", totals["groups"]).select(
        "key", "copies", parts.alias("parts"), F.pmod("seg", parts).alias("sub"),
        F.col("first.row").alias("row"), F.col("first.start").alias("start"), "n"))
    size = wanted.agg(F.coalesce(F.sum(F.col("n") + length), F.lit(0)).alias("b"),
                      F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("n"))), F.lit(0)).alias("w")).first()
    shards, cuts = int(size["b"] // SHARD_BYTES) + 1, int(size["w"] // MERGE_WINDOWS) + 1
    step = -(-(1 << 64) // cuts)

    def shard(group: pa.Table) -> pa.Table:
        get = {c: group.column(c).to_numpy() for c in ("row", "start", "copies", "parts", "n")}
        contents = group.column("content").to_pylist()
        segment, at, number, equal = shard_repeats(contents, get["n"], length)
        once = get["copies"][segment] == 1
        row, start = get["row"][segment], get["start"][segment] + at
        local = once & (equal > 1)
        m_row, m_start, m_n = runs(row[local], start[local])
        # one window per class of the split anchors goes on, with a place to mark if it is still alone
        split = np.flatnonzero(get["parts"][segment] > 1)
        split = split[np.unique(number[split], return_index=True)[1]]
        alone = once[split] & (equal[split] == 1)
        prints = [xxhash.xxh3_128_digest(contents[s][p:p + length]) for s, p in
                  zip(segment[split].tolist(), at[split].tolist())]
        words = np.frombuffer(b"".join(prints), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.argsort(words[:, 0], kind="stable")
        words = words[order]
        refs = np.stack([np.where(alone, row[split], -1), start[split]], axis=1)[order]
        edges = np.searchsorted(words[:, 0], np.array([min(c * step, (1 << 64) - 1) for c in range(1, cuts)], np.uint64))
        blobs = [(c, w.tobytes(), r.tobytes()) for c, (w, r) in
                 enumerate(zip(np.split(words, edges), np.split(refs, edges))) if len(w)]
        m, k = len(m_row), len(blobs)
        return pa.table({
            "row": pa.array([*m_row.tolist(), *[None] * k], pa.int64()),
            "start": pa.array([*m_start.tolist(), *[None] * k], pa.int64()),
            "n": pa.array([*m_n.tolist(), *[None] * k], pa.int64()),
            "cut": pa.array([*[None] * m, *[b[0] for b in blobs]], pa.int64()),
            "words": pa.array([*[None] * m, *[b[1] for b in blobs]], pa.binary()),
            "refs": pa.array([*[None] * m, *[b[2] for b in blobs]], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        level: list[Run] = []
        for words, refs in zip(group.column("words").to_pylist(), group.column("refs").to_pylist()):
            pair = np.frombuffer(words, np.uint64).reshape(-1, 2)
            level.append((pair[:, 0].copy(), pair[:, 1].copy(), np.frombuffer(refs, "i8,i8")))
        hit: list[np.ndarray] = []
        while len(level) > 1:
            level = [merge_two(*level[i:i + 2], hit) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        refs = np.unique(np.concatenate(hit)) if hit else np.zeros(0, "i8,i8")
        refs = refs[refs["f0"] >= 0]
        row, start, n = runs(refs["f0"], refs["f1"])
        return pa.table([pa.array(x, pa.int64()) for x in (row, start, n)], names=["row", "start", "n"])

    contents = _contents(docs, wanted, length)
    sharded = contents.withColumn("shard", F.pmod(F.xxhash64("key", "sub"), F.lit(shards)))
    done = stage_table(sharded.groupBy("shard").applyInArrow(
        shard, "row long, start long, n long, cut long, words binary, refs binary"))
    marks = marks.unionByName(done.filter("row is not null").select("row", "start", "n"))
    if cuts > 1 or size["w"]:
        across = done.filter("cut is not null").select("cut", "words", "refs")
        marks = marks.unionByName(across.groupBy("cut").applyInArrow(merge, "row long, start long, n long"))
    return marks


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = True, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining bytes, ``kept``) of every row, and its new ``text``.

    ``text`` reads the remaining bytes as UTF-8; characters that a removal has cut in two are left out of it.

    Removed are the bytes of all ``length``-byte strings that also start elsewhere, in any row or the same; strings
    are judged on the input. Null texts are empty; repeated rows are copies of each other; texts shorter
    than ``length`` stay whole. Other columns are not read.
    """
    rows = numbered(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))
    marks = repeated_windows(rows, length).groupBy(F.col("row").alias("_row")).agg(
        F.collect_list(F.struct("start", "n")).alias("marks"))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    schema += ", kept binary" if keep_bytes else ""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for value, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
                raw, pieces, done, removed, spans = (value or "").encode(), [], 0, 0, 0
                end = -1
                for s, n in sorted((m["start"], m["n"]) for m in marks or ()):
                    if s > end:
                        spans += 1
                        pieces.append(raw[done:s])
                        end = s
                    reach = s + n + length - 1
                    if reach > end:
                        removed += reach - end
                        end = reach
                    done = end
                pieces.append(raw[done:])
                kept = b"".join(pieces)
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), kept))
            columns = list(zip(*out))
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "kept"][: 6 if keep_bytes else 5]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays[: len(names)]], names=["doc_id", *names])

        return work

    joined = rows.join(marks, "_row", "left").select("doc_id", "text", "marks")
    return map_slices(joined, "text", make, schema)
