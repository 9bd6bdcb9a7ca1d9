"""Near-duplicate texts by SimHash with meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a value in common that lies within half the radius of
both. Every distinct fingerprint therefore emits all variants within half the radius; equal variants
meet, their owners are verified by their bit distance and linked.

Variants are shuffled by the bucket a fixed linear code gives them. Because the code is linear, the
flips that lead from a fingerprint into a bucket are known from the two code words, so the shuffle
carries a fingerprint once per bucket it reaches and the receiving task makes the variants. A
variant's owners are joined in a star, not in pairs, and one bucket returns a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcast.llm.base import map_slices, numbered, text_bytes
from eventcast.llm.components import components
from eventcast.operators.attach import attach
from eventcast.session import stage

SHINGLE = 4
RADIUS = 4
SEED = 42
LEAST_BUCKETS = 128
BUCKET_KEYS = 4_000_000  # fingerprints one bucket may hold before there are more buckets
PASS_VARIANTS = 2_000_000  # variants a task holds at once
BLOCK = 1 << 16  # shingles hashed at once
CODE_BITS = 48  # the widest code
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included.

    Words are runs without ASCII blanks, in lower case. With fewer words than ``shingle`` the whole
    sequence is the one shingle; without words the fingerprint is 0.
    """
    words = text.translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        starts, stops = [0], [len(flat)]
    else:
        starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
        stops = ends[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(flat[s:e], seed) for s, e in zip(starts[at:at + BLOCK], stops[at:at + BLOCK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long; null texts count as empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, offsets = text_bytes(batch.column("text"))
            raw = raw.tobytes()
            found = [fingerprint(raw[s:e], shingle) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

        return work

    return map_slices(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "text", make,
                      f"doc_id {kind}, fp long")


class BallCode:
    """A fixed linear code on 64-bit words with ``width`` bits.

    A wider code extends a narrower one at its lower end: the leading bits of both are the same.
    """

    def __init__(self, width: int, reach: int):
        label = np.random.default_rng(20).integers(0, 1 << CODE_BITS, 64) >> (CODE_BITS - width)
        table = np.zeros((8, 256), np.int64)
        for byte in range(8):
            for bit in range(8):
                table[byte, (np.arange(256) >> bit) & 1 == 1] ^= label[8 * byte + bit]
        self.table = table
        flips = [c for k in range(reach + 1) for c in combinations(range(64), k)]
        self.flips = np.array([sum(1 << b for b in c) for c in flips], np.uint64)
        self.codes = np.array([np.bitwise_xor.reduce(label[list(c)]) if c else 0 for c in flips])
        self.by_code = np.argsort(self.codes, kind="stable")
        self.sorted_codes = self.codes[self.by_code]

    def of(self, keys: np.ndarray) -> np.ndarray:
        parts = keys.view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(keys), np.int64)
        for byte in range(8):
            out ^= self.table[byte][parts[:, byte]]
        return out


@lru_cache(maxsize=8)
def ball_code(width: int, reach: int) -> BallCode:
    """The code, made once per process: a task meets many buckets, and making it takes longer than a small bucket."""
    return BallCode(width, reach)


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of ``size`` indices over links a-b."""
    label = np.arange(size)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], np.minimum(la, lb)[open_], np.maximum(la, lb)[open_]
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def ball_size(reach: int) -> int:
    """Words within ``reach`` bits of a 64-bit word."""
    return sum(comb(64, k) for k in range(reach + 1))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def bucket_links(keys: np.ndarray, bucket: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (root, member) of the fingerprints that share a variant in this bucket."""
    keys = np.unique(keys)
    reach = radius // 2
    extra = 0
    while (len(keys) * ball_size(reach) >> (bits + extra)) > PASS_VARIANTS:
        extra += 1  # the variants of the bucket are made in several passes, one per value of these further code bits
    code = ball_code(bits + extra, reach)
    words = code.of(keys)
    order = np.argsort(words, kind="stable")
    levels, first = np.unique(words[order], return_index=True)
    members = np.split(order, first[1:])
    a, b = [], []
    for sub in range(1 << extra):
        target = bucket << extra | sub
        variants, owners = [], []
        for level, own in zip(levels.tolist(), members):
            wanted = level ^ target
            lo, hi = np.searchsorted(code.sorted_codes, (wanted, wanted + 1))
            if lo < hi:
                flips = code.flips[code.by_code[lo:hi]]
                variants.append((keys[own][:, None] ^ flips).ravel())
                owners.append(np.repeat(own, hi - lo))
        if not variants:
            continue
        values, who = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(values)
        values, who = values[order], who[order]
        same = values[1:] == values[:-1]
        begins = np.flatnonzero(np.concatenate([[True], ~same]))
        sizes = np.diff(np.append(begins, len(values)))
        shared = sizes > 1
        head = np.repeat(who[begins[shared]], sizes[shared])
        rest = who[np.repeat(shared, sizes)]
        pair = np.unique(np.minimum(head, rest) * len(keys) + np.maximum(head, rest))
        x, y = pair // len(keys), pair % len(keys)
        near = (x != y) & (_distance(keys[x], keys[y]) <= radius)
        a.append(x[near])
        b.append(y[near])
    if not a:
        return keys[:0], keys[:0]
    label = _forest(len(keys), np.concatenate(a), np.concatenate(b))
    member = np.flatnonzero(label != np.arange(len(keys)))
    return keys[label[member]], keys[member]


def ball_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose closure is that of all pairs within ``radius``.

    ``radius`` must be even. The number of buckets grows with the fingerprints once they exceed what
    a bucket may hold.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    reach = radius // 2
    bits = LEAST_BUCKETS.bit_length() - 1
    total = nodes.count()
    while total * min(1.0, ball_size(reach) / (1 << bits)) > BUCKET_KEYS:
        bits += 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = ball_code(bits, reach)
        reached = np.unique(code.codes)
        step = max(1, 4_000_000 // len(reached))
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), step):
                keys = every[at:at + step]
                buckets = (code.of(keys)[:, None] ^ reached).ravel()
                order = np.argsort(buckets, kind="stable")
                sent = np.repeat(keys, len(reached))[order]
                names, first = np.unique(buckets[order], return_index=True)
                blobs = [part.tobytes() for part in np.split(sent, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())],
                                                 names=["bucket", "keys"])

    def meet(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64)
        a, b = bucket_links(keys, group.column("bucket")[0].as_py(), bits, radius)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    sent = nodes.select("fp").mapInArrow(emit, "bucket long, keys binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least doc_id linked to it over any chain.

    Rows with equal fingerprints belong together, also the fingerprint 0 of texts without words.
    """
    prints = stage(fingerprints(docs, shingle=shingle))
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(stage(ball_links(nodes, radius)))
    named = nodes.join(roots.withColumnRenamed("key", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stage(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = attach(named.select("fp", "root"), least, "root").select("fp", "component_id")
    return attach(prints, found, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_groups(docs).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates: the one with the least doc_id, of repeated rows the first.

    Rows with a null doc_id stay: nothing names them as copies. All columns are returned as they are.
    """
    rows = numbered(docs, "_simhash_row")
    keyed = rows.select(F.struct(F.col("doc_id").alias("d"), F.col("_simhash_row").alias("r")).alias("doc_id"), "text")
    groups = near_groups(keyed.filter("doc_id.d is not null"), radius, shingle)
    kept = groups.select(F.col("component_id.r").alias("_simhash_row")).distinct()
    stays = rows.filter("doc_id is not null").join(kept, "_simhash_row", "left_semi")
    return stays.unionByName(rows.filter("doc_id is null")).select(*docs.columns)
