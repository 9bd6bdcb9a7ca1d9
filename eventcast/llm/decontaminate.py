"""Benchmark passages in documents by the q-gram lemma over diagonal bands and banded alignment.

Benchmark items are cut into overlapping stretches of at most 100 characters. A text region within ``e`` edits
of a stretch of ``m`` characters shares at least ``m + 1 - q - q * e`` of its q-grams, all on ``e + 1`` neighbouring
diagonals. Shared q-grams are therefore counted per stretch in overlapping bands of diagonals; bands that
reach the bound are aligned within the band, and those within the budget are reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from eventcast.llm.base import map_slices, ramp

Q = 8
STRETCH = 100
EDIT_SHARE = 0.1
BLOCK_CHARS = 4_000_000  # benchmark characters in one broadcast index; more go in further blocks
TEXT_BLOCK = 1 << 18  # characters of a text looked at together
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
BITS = 20


def characters(text: str) -> np.ndarray:
    """Code points with ASCII letters in lower case and ASCII blanks as spaces."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return np.where((out >= 9) & (out <= 13), 32, out).astype(np.uint32)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the eight characters from each position on."""
    h = codes.astype(np.uint64)
    for width, mix in zip((1, 2, 4), MIX):
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * mix + h[width:]
    return (h ^ (h >> np.uint64(31))) * MIX[0]


@dataclass
class GramIndex:
    """q-grams of the stretches: sorted hashes with the places (stretch, offset) of each."""

    items: np.ndarray  # item number of each stretch
    stretches: list[np.ndarray]
    sizes: np.ndarray
    budgets: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    stretch: np.ndarray
    offset: np.ndarray
    seen: np.ndarray  # whether any hash has these leading bits
    short: dict[str, list[int]]  # items under q characters, found only as whole texts
    band: int


def edit_budget(size: int) -> int:
    """A tenth of the characters, or less where the lemma would then demand no shared q-gram."""
    return max(0, min(int(size * EDIT_SHARE), (size - Q) // Q))


def build_index(texts: list[str]) -> GramIndex:
    items, stretches, short = [], [], {}
    for number, text in enumerate(texts):
        codes = characters(text.strip())
        if len(codes) < Q:
            if len(codes):
                short.setdefault(codes.tobytes(), []).append(number)
            continue
        last = max(0, len(codes) - STRETCH)
        for start in sorted({*range(0, last + 1, STRETCH // 2), last}):
            items.append(number)
            stretches.append(codes[start:start + STRETCH])
    sizes = np.array([len(s) for s in stretches], np.int64)
    budgets = np.array([edit_budget(int(s)) for s in sizes], np.int64)
    grams = [gram_hashes(s) for s in stretches]
    counts = np.array([len(g) for g in grams], np.int64)
    flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    owner, offset = np.repeat(np.arange(len(stretches)), counts), ramp(counts)
    order = np.argsort(flat, kind="stable")
    hashes, first = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << BITS, bool)
    seen[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return GramIndex(np.array(items, np.int64), stretches, sizes, budgets, sizes + 1 - Q - Q * budgets, hashes,
                     np.append(first, len(flat)), owner[order], offset[order], seen, short, 16)


def band_candidates(index: GramIndex, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, first diagonal of the band) of the bands that hold enough shared q-grams.

    Bands are ``band`` diagonals wide and reach ``budget`` further, so some band holds any run of
    ``budget + 1`` diagonals whole.
    """
    grams = gram_hashes(codes)
    at = np.flatnonzero(index.seen[(grams >> np.uint64(64 - BITS)).astype(np.int64)])
    slot = np.searchsorted(index.hashes, grams[at])
    slot[slot == len(index.hashes)] = 0
    real = index.hashes[slot] == grams[at]
    at, slot = at[real], slot[real]
    number = index.first[slot + 1] - index.first[slot]
    place = np.repeat(index.first[slot], number) + ramp(number)
    stretch = index.stretch[place]
    diagonal = np.repeat(at, number) - index.offset[place] + STRETCH  # not negative
    band = diagonal // index.band
    again = (diagonal % index.band < index.budgets[stretch]) & (band > 0)
    wide = (len(codes) + STRETCH) // index.band + 2
    key = np.concatenate([stretch * wide + band, stretch[again] * wide + band[again] - 1])
    key.sort()
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    counts = np.diff(np.append(begins, len(key)))
    key = key[begins]
    enough = counts >= index.bounds[key // wide]
    key = key[enough]
    return key // wide, key % wide * index.band - STRETCH


def align(pattern: np.ndarray, regions: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of the pattern against any part of each region inside the band, and where it ends.

    ``regions`` (n, m + width - 1) are padded with a value no pattern has; diagonal k starts at column k.
    """
    cost = np.zeros((len(regions), width), np.int32)
    along = np.arange(width, dtype=np.int32)
    for i, c in enumerate(pattern):
        step = cost + (regions[:, i:i + width] != c)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a character of the pattern left out
        cost = np.minimum.accumulate(step - along, axis=1) + along  # characters of the text left out
    best = cost.argmin(1)
    return cost[np.arange(len(cost)), best], best + len(pattern)


def find_passages(index: GramIndex, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the best place of each item in each text."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    waiting: dict[int, list] = {}
    for row, text in enumerate(texts):
        codes = characters(text or "")
        if index.short and text and len(bare := text.strip()) < Q:
            lead = len(text) - len(text.lstrip())
            for number in index.short.get(characters(bare).tobytes(), ()):
                best[row, number] = (0, lead, lead + len(bare))
        if not len(index.hashes):
            continue
        for start in range(0, max(1, len(codes) - Q + 1), TEXT_BLOCK):
            part = codes[start:start + TEXT_BLOCK + 2 * STRETCH]
            if len(part) < Q:
                continue
            for stretch, diagonal in zip(*(x.tolist() for x in band_candidates(index, part))):
                waiting.setdefault(stretch, []).append((row, start + diagonal, codes))
    for stretch, places in waiting.items():
        pattern, budget = index.stretches[stretch], int(index.budgets[stretch])
        width = index.band + 3 * budget
        size = len(pattern) + width - 1
        for at in range(0, len(places), 512):
            some = places[at:at + 512]
            regions = np.full((len(some), size), 0xFFFFFFFF, np.uint32)
            for n, (_, diagonal, codes) in enumerate(some):
                first = diagonal - budget
                part = codes[max(first, 0):first + size]
                regions[n, max(-first, 0):max(-first, 0) + len(part)] = part
            edits, ends = align(pattern, regions, width)
            for n in np.flatnonzero(edits <= budget).tolist():
                row, diagonal, _ = some[n]
                end = diagonal - budget + int(ends[n])
                key = (row, int(index.items[stretch]))
                found = (int(edits[n]), max(0, end - len(pattern)), end)
                best[key] = min(found, best.get(key, found))
    return [(row, item, start, end, edits) for (row, item), (edits, start, end) in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Benchmark items in blocks of bounded size, each small enough to send to every executor."""
    items = benchmark.filter(F.col("text").isNotNull() & (F.trim("text") != "")).select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = int(total // BLOCK_CHARS) + 1
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (str(r["item_id"]), r["text"]))
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): one row per row of ``docs`` and item it holds a stretch of.

    Positions count characters; of several places the one with the fewest edits is given. Null and
    empty texts and items match nothing; items under eight characters match only a text that is the item, but for
    blanks around either. Ids may be of any type that Arrow knows.
    Benchmarks of any size are taken in blocks, all documents against each.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_schema(benchmark.select("item_id").schema).field(0).type
    schema = f"doc_id {kind}, item_id {item_kind}, start long, end long, edits int"
    out = spark.createDataFrame([], schema)
    for ids, texts in _blocks(benchmark):
        shared = spark.sparkContext.broadcast((ids, build_index(texts)))

        def make(shared=shared):
            names, index = shared.value

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows = find_passages(index, batch.column("text").to_pylist())
                row, item, start, end, edits = zip(*rows) if rows else ([],) * 5
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())),
                     pa.array([names[i] for i in item], item_type), pa.array(start, pa.int64()),
                     pa.array(end, pa.int64()), pa.array(edits, pa.int32())],
                    names=["doc_id", "item_id", "start", "end", "edits"])

            return work

        out = out.unionByName(map_slices(docs.select("doc_id", "text"), "text", make, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a stretch of a benchmark item; all columns as they are."""
    spark = docs.sparkSession
    for _, texts in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(build_index(texts))

        def make(shared=shared):
            index = shared.value

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in find_passages(index, batch.column("text").to_pylist()):
                    keep[row] = False
                return batch.filter(pa.array(keep))

            return work

        docs = map_slices(docs, "text", make, docs.schema)
    return docs
