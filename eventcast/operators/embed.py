"""Word vectors from co-occurrence counts, and their lookup."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventcast.operators.attach import attach
from eventcast.session import CLEANUP_KEY, drop_table, new_path, own_session, stage_path, stage_table

ROUNDS = 2
TILE_WORDS = 80_000  # words of a block, so of a tile of the counts either way
TILE_WEIGHTS = 4_000_000  # pairs of a tile, met again or not
SUM_WORDS = 1 << 10  # words whose vectors are added up, or leave a task, at a time
SUM_ROWS = 1 << 19  # tokens whose pairs are counted at a time
LONG_ROW = 96  # a word's weights in a tile beyond which they are added up in one step
START_BYTES = 32 << 20  # start vectors up to this size go through the rounds whole,
START_SIZE = 25  # larger ones by so many components at a time
HASHES = 1 << 13  # words hashed at a time
PLAIN = {"compression": "none"}  # what is compressed already: another codec would hold each large value twice more
BATCH_BYTES = "8m"  # what a round's tasks read at a time

PLACE_BITS = 17  # of the place of a word in its block
PLACES = (1 << PLACE_BITS) - 1
CHUNK = "chunk long, words array<string>, totals array<long>, codes binary, lengths binary"
TILE = "i int, j int, rows binary, cols binary, counts binary"
BLOCK = "i int, words array<string>, totals binary"
VECTORS = "i int, first int, v binary, s binary"
# What a task of a round reads, rows of several kinds.
PART = pa.schema([("kind", pa.string()), ("i", pa.int32()), ("j", pa.int32()), *((c, pa.binary()) for c in "xyz"), ("words", pa.list_(pa.string()))])


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed planes of bytes."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = b"".join((values >> 8 * k).astype(np.uint8).tobytes() for k in range(width))
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    count, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(pa.decompress(data[9:], count * width, "zstd"), np.uint8).reshape(width, count)
    out = planes[0].astype(np.int64)
    for k in range(1, width):
        out |= planes[k].astype(np.int64) << 8 * k
    return out


def _vector_bytes(values: np.ndarray) -> bytes:
    """Doubles without loss: the lower 48 bits as they are, the upper 16 as compressed planes of bytes."""
    bits = np.ascontiguousarray(values, np.float64).view(np.uint64).ravel()
    top = b"".join((bits >> np.uint64(k)).astype(np.uint8).tobytes() for k in (48, 56))
    low = bits.astype(np.uint32).tobytes() + (bits >> np.uint64(32)).astype(np.uint16).tobytes()
    return len(bits).to_bytes(8, "little") + low + pa.compress(top, "zstd", asbytes=True)


def _vector_values(data: bytes, rows: int, start: bool) -> np.ndarray:
    """(row, component) of what ``_vector_bytes`` or, for ``start``, ``_start_vectors`` wrote."""
    if start:
        return (np.frombuffer(data, np.uint32).astype(np.float64) / 2.0**31 - 1.0).reshape(rows, -1)
    count = int.from_bytes(data[:8], "little")
    low, middle = np.frombuffer(data, np.uint32, count, 8), np.frombuffer(data, np.uint16, count, 8 + 4 * count)
    top = np.frombuffer(pa.decompress(data[8 + 6 * count:], 2 * count, "zstd"), np.uint8).reshape(2, count)
    out = np.empty((count, 2), np.uint32)
    out[:, 0] = low
    for k in range(0, count, 1 << 16):
        some = slice(k, k + (1 << 16))
        out[some, 1] = top[1, some].astype(np.uint32) << 24 | top[0, some].astype(np.uint32) << 16 | middle[some]
    return out.view(np.float64).reshape(rows, -1)


def _same_text(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def _chunk_row(chunk: int, texts: list[pa.Array], window: int) -> pa.RecordBatch:
    """Texts as codes of their words, the commonest first; code 0 is a null token. With the totals of the co-occurrence counts."""
    flat = pa.concat_arrays([t.flatten() for t in texts]).dictionary_encode()
    lengths = np.concatenate([np.diff(t.offsets.to_numpy()) for t in texts])
    at = flat.indices.fill_null(-1).to_numpy() + 1
    order = np.argsort(-np.bincount(at, minlength=len(flat.dictionary) + 1)[1:], kind="stable")
    renamed = np.zeros(len(order) + 1, np.int64)
    renamed[order + 1] = np.arange(1, len(order) + 1)
    codes, text, size = renamed[at], _same_text(lengths), len(order) + 1
    totals = np.bincount(codes, minlength=size)
    for k in range(1, window + 1):
        near = text[k:] == text[:-k]
        one, two = codes[:-k][near], codes[k:][near]
        totals += np.bincount(one, minlength=size)
        totals += np.bincount(two[(one != two) & (one > 0) & (two > 0)], minlength=size)
    words = pa.concat_arrays([pa.nulls(1, pa.string()), flat.dictionary.cast(pa.string()).take(pa.array(order))])
    whole = [0, size]
    return pa.RecordBatch.from_arrays([
        pa.array([chunk]), pa.ListArray.from_arrays(whole, words), pa.ListArray.from_arrays(whole, pa.array(totals, pa.int64())),
        pa.array([_packed(codes)], pa.binary()), pa.array([_packed(lengths)], pa.binary())],
        names=["chunk", "words", "totals", "codes", "lengths"])


def coded_texts(tokens: DataFrame, column: str, window: int = 5) -> DataFrame:
    """Texts by chunks of about ``SUM_ROWS`` tokens: the words of a chunk, their totals in it, its tokens as codes."""
    most = SUM_ROWS

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, room = TaskContext.get().partitionId() << 32, [], most
        for batch in batches:
            texts = batch.column(0)
            ends, low = texts.offsets.to_numpy()[1:] - texts.offsets[0].as_py(), 0
            while low < len(texts):
                begun = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, begun + room, "right")))
                held.append(texts.slice(low, high - low))
                room, low = room - int(ends[high - 1] - begun), high
                if room <= 0 or low < len(texts):
                    yield _chunk_row(chunk, held, window)
                    chunk, held, room = chunk + 1, [], most
        if held:
            yield _chunk_row(chunk, held, window)

    return tokens.select(column).filter(F.size(column) > 0).mapInArrow(code, CHUNK)


def _tile_rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of ``TILE`` from pairs in order: block and block of the two words, place and place."""
    tile = keys >> 2 * PLACE_BITS
    heads = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(keys) else keys
    for low, high in zip(heads, np.append(heads[1:], len(keys)), strict=True):
        row = keys[low:high] >> PLACE_BITS & PLACES
        yield (int(tile[low] >> 13), int(tile[low] & 8191), _packed(np.diff(row, prepend=0)), _packed(keys[low:high] & PLACES),
               _packed(counts[low:high]))


def _tile_table(rows: Iterator[tuple]) -> pa.Table:
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), *((c, pa.binary()) for c in ("rows", "cols", "counts"))])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 5, schema, strict=True)], schema=schema)


def _tile_values(rows: bytes, cols: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(rows)), _unpacked(cols), _unpacked(counts)


def cooccurrences(coded: DataFrame, places: DataFrame, window: int = 5) -> DataFrame:
    """(i, j, rows, cols, counts): how often two words stand at most ``window`` places apart, in either order, and each word with itself.

    ``places`` (chunk, code, i, r) has the block of each word of a chunk and its place there. A tile holds the pairs of two blocks;
    a pair of different words is there once. Counts are combined per chunk, so frequent words cost no more than others.
    """

    def count(codes: pa.Table, words: pa.Table) -> pa.Table:
        if not codes.num_rows or not words.num_rows:
            return _tile_table(iter(()))
        token, text = _unpacked(codes["codes"][0].as_py()), _same_text(_unpacked(codes["lengths"][0].as_py()))
        place = np.full(int(token.max()) + 1, -1)
        place[words["code"].to_numpy()] = words["i"].to_numpy().astype(np.int64) << PLACE_BITS | words["r"].to_numpy()
        token, end = place[token], 0
        reach = range(min(window, len(token) - 1) + 1)
        keys = np.empty(len(token) * len(reach), np.int64)
        for k in reach:
            one, two = token[:len(token) - k], token[k:]
            near = np.flatnonzero((text[:len(token) - k] == text[k:]) & (one >= 0) & (two >= 0))
            one, two = one[near], two[near]
            least, most = np.minimum(one, two), np.maximum(one, two)
            # Block and block, place and place.
            own = keys[end:end + len(near)]
            np.bitwise_or(least >> PLACE_BITS << 13, most >> PLACE_BITS, out=own)
            own <<= PLACE_BITS
            own |= least & PLACES
            own <<= PLACE_BITS
            own |= most & PLACES
            end += len(near)
        keys = keys[:end]
        keys.sort()
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
        return _tile_table(_tile_rows(keys[heads], np.diff(heads, append=len(keys))))

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        parts = [_tile_values(*(group[c][k].as_py() for c in ("rows", "cols", "counts"))) for k in range(group.num_rows)]
        keys = np.concatenate([r << PLACE_BITS | c for r, c, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([n for *_, n in parts])[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        tile = (key[0].as_py() << 13 | key[1].as_py()) << 2 * PLACE_BITS
        return _tile_table(_tile_rows(keys[heads] | tile, np.add.reduceat(counts, heads)))

    met = coded.select("chunk", "codes", "lengths").groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(count, TILE)
    return met.groupBy("i", "j").applyInArrow(merge, TILE)


def _files(df: DataFrame, *by: str) -> tuple[str, dict[tuple[int, ...], list[str]]]:
    """Writes ``df`` in files of their own per value of the columns ``by``; the folder, and the files per value."""
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.withColumns({f"_{c}": F.col(c) for c in by}).write.options(**PLAIN).partitionBy(*[f"_{c}" for c in by]).parquet(path)
    found = defaultdict(list)
    for file in spark.read.schema(df.schema).parquet(path).inputFiles():
        found[tuple(int(re.search(rf"/_{c}=(\d+)/", file)[1]) for c in by)].append(file)
    return path, dict(found)


def _md5_words(blocks: np.ndarray) -> np.ndarray:
    """First four bytes, as a little-endian number, of the MD5 digests of padded messages of one block; (16, messages) of 32 bits each."""
    a, b, c, d = (np.full(blocks.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t, u = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif k < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif k < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        t += np.uint32(int(abs(math.sin(k + 1)) * 2**32))
        t += blocks[(k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16]
        left = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[k // 16][k % 4]
        np.left_shift(t, np.uint32(left), out=u)
        t >>= np.uint32(32 - left)
        u |= t
        u += b
        a, d, c, b, u = d, c, b, u, a
    return a + np.uint32(0x67452301)


def _start_values(words: list[bytes], first: int, size: int) -> np.ndarray:
    """(word, component): the first 32 bits of the MD5 digest of "word:component"."""
    out = np.empty((len(words), size), np.uint32)
    for low in range(0, len(words), HASHES):
        some = words[low:low + HASHES]
        length = np.array([len(w) for w in some])
        short = np.flatnonzero(length <= 40)
        for k in np.flatnonzero(length > 40):
            out[low + k] = [int.from_bytes(hashlib.md5(some[k] + b":%d" % c).digest()[:4], "big") for c in range(first, first + size)]
        length = length[short]
        begin = np.arange(len(short)) * 64
        base = np.zeros(len(short) * 64, np.uint8)
        text = np.frombuffer(b"".join(some[k] for k in short), np.uint8)
        base[np.repeat(begin - np.cumsum(length) + length, length) + np.arange(len(text))] = text
        for k in range(size):
            tail = b":%d\x80" % (first + k)
            block = base.copy()
            for n, byte in enumerate(tail):
                block[begin + length + n] = byte
            bits = (length + len(tail) - 1) * 8
            block[begin + 56], block[begin + 57] = bits & 255, bits >> 8
            out[low + short, k] = _md5_words(np.ascontiguousarray(block.view("<u4").reshape(-1, 16).T)).byteswap()
    return out


def _start_vectors(blocks: DataFrame, first: int, size: int) -> DataFrame:
    """``VECTORS`` of the start vectors' components from ``first`` on, as the 32 bits they are made of."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in zip(batch.column("i").to_pylist(), batch.column("words"), strict=True):
                values = _start_values(words.values.cast(pa.binary()).to_pylist(), first, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([first], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.nulls(1, pa.binary())],
                    names=["i", "first", "v", "s"])

    return blocks.select("i", "words").mapInArrow(start, VECTORS)


def _add_products(out: np.ndarray, row: np.ndarray, col: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> None:
    """Adds ``weight`` times the vector of ``col`` to ``out`` at ``row``; rows in order.

    Words with about as many weights go together, first weight by first weight, so that all steps are over small dense blocks.
    """
    count = np.bincount(row, minlength=len(out))
    begin = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")[:np.count_nonzero(count)]
    room = np.empty((SUM_WORDS, vectors.shape[1]))
    for low in range(0, len(order), SUM_WORDS):
        some = order[low:low + SUM_WORDS]
        at, less = begin[some], -count[some]
        sums = np.zeros((len(some), vectors.shape[1]))
        longer = int(np.searchsorted(less, -LONG_ROW))
        for k in range(longer):
            own = slice(at[k], at[k] - less[k])
            sums[k] = weight[own] @ vectors[col[own]]
        for k in range(-less[longer] if longer < len(some) else 0):
            high = int(np.searchsorted(less, -k))
            own = at[longer:high] + k
            part = np.take(vectors, col[own], axis=0, out=room[:high - longer], mode="clip")
            part *= weight[own, None]
            sums[longer:high] += part
        out[some] += sums


class _Part:
    """What one task adds up: the vectors of the words of block ``a``. The last round holds the sum of all rounds."""

    def __init__(self, total: float, start: bool, size: int | None, still: bool):
        self.total, self.start, self.size, self.still, self.a = total, start, size, still, None
        self.near, self.totals, self.tiles, self.late, self.words = -1, {}, {}, [], None
        self.sums, self.own, self.whole = {}, {}, None

    def take(self, kind: str, i: int, j: int, x, y, z, words) -> None:
        if kind == "head":
            if self.a is not None:
                raise ValueError(f"blocks {self.a} and {i} in one partition")
            self.a, self.near = i, j
        elif kind == "totals":
            self.totals[i] = np.frombuffer(x.as_py())
        elif kind == "tile":
            self.tiles[i, j] = tuple(v.as_py() for v in (x, y, z))
        elif kind == "words":
            self.words = words.values
        elif not len(self.tiles) == len(self.totals) == self.near:
            self.late.append((i, j, x, y))
        else:
            self.add(i, j, x, y)

    def weights(self, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, col, weight) of the tile of the own words by those of block ``j``, or the other way round if its number is less."""
        at = (min(self.a, j), max(self.a, j))
        row, col, n = _tile_values(*self.tiles[at])
        weight = n * self.total
        weight /= self.totals[at[0]][row] * self.totals[at[1]][col]
        return row, col, np.maximum(np.log(weight, out=weight), 0.0, out=weight)

    def ways(self, j: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same with the own words as rows, in order; each pair of the own block comes in both orders."""
        row, col, weight = self.weights(j)
        if self.a <= j:
            yield row, col, weight
        if self.a == j:
            two = np.flatnonzero(row != col)
            row, col, weight = row[two], col[two], weight[two]
        if self.a >= j:
            order = np.sort(col << 32 | np.arange(len(col))) & (1 << 32) - 1
            yield col[order], row[order], weight[order]

    def add(self, j: int, first: int, v, s) -> None:
        """Adds the part of the words of block ``j``."""
        here, last = len(self.totals[self.a]), self.size is not None
        if self.whole is None:
            self.whole, self.seen = np.zeros(here), set()
            if last:
                self.sums = np.zeros((here, self.size))
                for one, two in () if self.still else self.tiles:
                    for row, _, weight in self.ways(one + two - self.a):
                        self.whole += np.bincount(row, weight, here)
        vectors = _vector_values(v.as_buffer(), len(self.totals[j]), self.start)
        if last:
            sums = self.sums[:, first:first + vectors.shape[1]]
            if not self.still:
                self.divide(j, sums, vectors)
            if j == self.a:
                if self.still or not self.start:
                    sums += vectors if not s.is_valid else _vector_values(s.as_buffer(), here, False)
                if not self.still:
                    alone = self.whole == 0
                    sums[alone] += vectors[alone]
            return
        if j == self.a:
            self.own[first] = (vectors, _vector_values(s.as_buffer(), here, False) if s.is_valid else None)
        sums = self.sums.setdefault(first, np.zeros((here, vectors.shape[1])))
        for row, col, weight in self.ways(j):
            if j not in self.seen:
                self.whole += np.bincount(row, weight, here)
            _add_products(sums, row, col, weight, vectors)
        self.seen.add(j)

    def divide(self, j: int, sums: np.ndarray, vectors: np.ndarray) -> None:
        some = np.where(self.whole > 0, self.whole, 1.0)
        for row, col, weight in self.ways(j):
            _add_products(sums, row, col, weight / some[row], vectors)

    def end(self) -> None:
        if not len(self.tiles) == len(self.totals) == self.near:
            raise ValueError(f"{len(self.tiles)} tiles and totals of {len(self.totals)} blocks for block {self.a}, {self.near} expected")
        for late in self.late:
            self.add(*late)
        self.late = []

    def results(self) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(first, vectors, the sum of all rounds' vectors unless it is the same)."""
        for first, (vectors, before) in self.own.items():
            # Words without any weight keep themselves.
            alone, sums = (self.whole == 0)[:, None], self.sums.pop(first)
            sums /= np.where(alone[:, 0], 1.0, self.whole)[:, None]
            sums = np.where(alone, vectors, sums)
            yield first, sums, None if self.start else sums + (vectors if before is None else before)


def _round(parts: DataFrame, total: float, start: bool, rounds: int | None = None, size: int | None = None) -> DataFrame:
    """One round as ``VECTORS``; given all ``rounds``, the last one and their mean as (word, vector). A partition holds what one block takes."""

    def read(batches: Iterator[pa.RecordBatch]) -> _Part:
        part = _Part(total, start, size, rounds == 0)
        for batch in batches:
            kinds, i, j, *rest = (batch.column(c) for c in PART.names)
            for k, (kind, one, two) in enumerate(zip(kinds.to_pylist(), i.to_pylist(), j.to_pylist(), strict=True)):
                part.take(kind, one, two, *(c[k] for c in rest))
            del batch, kinds, i, j, rest  # before the next one is read
        if part.a is not None:
            part.end()
        return part

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = read(batches)
        for first, vectors, before in part.results():
            both = [_vector_bytes(vectors), None if before is None else _vector_bytes(before)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.a], pa.int32()), pa.array([first], pa.int32()), *(pa.array([x], pa.binary()) for x in both)],
                names=["i", "first", "v", "s"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = read(batches)
        for low in range(0, len(part.sums), SUM_WORDS):
            some = part.sums[low:low + SUM_WORDS] / max(1, rounds)
            vectors = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * np.int32(size), pa.array(some.ravel()))
            yield pa.RecordBatch.from_arrays([part.words.slice(low, len(some)), vectors], names=["word", "vector"])

    return parts.mapInArrow(middle, VECTORS) if rounds is None else parts.mapInArrow(last, "word string, vector array<double>")


def _union(frames: list[DataFrame]) -> DataFrame:
    while len(frames) > 1:
        frames = [a.union(b) for a, b in zip(frames[::2], frames[1::2])] + frames[len(frames) // 2 * 2:]
    return frames[0]


def _row(df: DataFrame, kind: str, **columns) -> DataFrame:
    """``df`` as rows of ``PART``."""
    empty = {"i": "int", "j": "int", "x": "binary", "y": "binary", "z": "binary", "words": "array<string>"}
    return df.select(F.lit(kind).alias("kind"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()])


class Counts:
    """The staged words, by block, and tiles of their co-occurrence counts."""

    def __init__(self, spark: SparkSession, words: int, total: float, blocks: tuple, tiles: tuple):
        self.words, self.total = words, total
        (path, block_files), (tile_path, tile_files) = blocks, tiles
        self.blocks, self.tiles = spark.read.schema(BLOCK).parquet(path), spark.read.schema(TILE).parquet(tile_path)
        self.totals = stage_table(self.blocks.select("i", "totals").coalesce(1))
        self.own, self.fixed, self.beside = {}, {}, defaultdict(set)
        for i, j in tile_files:
            self.beside[i].add(j)
            self.beside[j].add(i)
        totals = _row(self.totals, "totals", i=F.col("i"), x=F.col("totals"))
        for (a,), files in sorted(block_files.items()):
            near = sorted(self.beside[a])
            # The block's number comes as a row: as a literal, every block would have code of its own compiled.
            head = spark.createDataFrame(pa.Table.from_pylist([{"kind": "head", "i": a, "j": len(near)}], schema=PART))
            tiles = spark.read.schema(TILE).parquet(*[f for j in near for f in tile_files[min(a, j), max(a, j)]])
            tiles = _row(tiles, "tile", i=F.col("i"), j=F.col("j"), x=F.col("rows"), y=F.col("cols"), z=F.col("counts"))
            self.own[a] = _row(spark.read.schema(BLOCK).parquet(*files), "words", words=F.col("words"))
            self.fixed[a] = _union([head, self.beside_only(totals, a), tiles])

    def beside_only(self, df: DataFrame, a: int) -> DataFrame:
        near = self.beside[a]
        return df if len(near) == len(self.beside) else df.filter(F.col("i").isin(*near))

    def parts(self, vectors: list[DataFrame], words: bool = False) -> DataFrame:
        """One partition per block: its words on request, the totals and tiles it needs, and the vectors of the blocks beside it.

        Each partition reads the staged files itself; nothing is shuffled, as the vectors would be, once for every block.
        """
        every = [_row(v, "vectors", i=F.col("i"), j=F.col("first"), x=F.col("v"), y=F.col("s")) for v in vectors]
        found = [
            _union([self.own[a]] * words + [fixed, *[self.beside_only(v, a) for v in every]]).coalesce(1) for a, fixed in self.fixed.items()]
        # Spark joins the partitions of a union whose parts are laid out alike, as single ones are; an empty part that isn't keeps them apart.
        return _union([*found, _row(self.blocks.filter("i < 0"), "none")])


def word_counts(tokens: DataFrame, column: str, window: int = 5, min_count: int = 1) -> Counts | None:
    """Words numbered by block and by place in it, the commonest first, and how often they stand near each other; None without a word.

    The counts, and the rounds over them, belong to a session of their own, with its settings.
    """
    spark = own_session(tokens.sparkSession, **{CLEANUP_KEY: "true", "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES})
    if min_count > 1:
        words = tokens.select(F.explode(column).alias("w")).groupBy("w").count().filter(F.col("count") >= min_count)
        numbered = tokens.select(F.monotonically_increasing_id().alias("_text"), column)
        numbered = stage_table(numbered)
        placed = attach(numbered.select("_text", F.posexplode(column).alias("at", "w")), words.select("w"), "w", "left_semi")
        tokens = placed.groupBy("_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias(column))
    coded = spark.read.schema(CHUNK).parquet(stage_path(coded_texts(tokens, column, window)))
    seen = coded.select("chunk", F.posexplode(F.arrays_zip("words", "totals")).alias("code", "w"))
    seen = seen.select(F.col("w.words").alias("word"), F.col("w.totals").alias("total"), F.struct("chunk", "code").alias("at"))
    seen = stage_table(seen.groupBy("word").agg(F.sum("total").alias("total"), F.collect_list("at").alias("at")))
    count, total = seen.agg(F.count("word"), F.sum("total")).first()
    if not count:
        return None
    pairs = min(count * (count + 1) // 2, (total + count) // 2)  # at most
    across = max(-(-count // TILE_WORDS), math.ceil(math.sqrt(2 * pairs / TILE_WEIGHTS)))
    if across > 1 << 13:
        raise ValueError(f"{count} words need more than {1 << 13} blocks")
    place = Window.partitionBy("i").orderBy(F.desc("total"), "word")
    known = seen.filter("word IS NOT NULL").withColumn("i", F.pmod(F.xxhash64("word"), F.lit(across)).cast("int"))
    known = stage_table(known.withColumn("r", F.row_number().over(place) - 1))
    drop_table(seen)

    def block(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("r")
        words = pa.ListArray.from_arrays([0, len(group)], group["word"].combine_chunks())
        totals = group["total"].to_numpy().astype(np.float64).tobytes()
        return pa.table([pa.array([key[0].as_py()], pa.int32()), words, pa.array([totals], pa.binary())], names=["i", "words", "totals"])

    blocks = _files(known.select("i", "r", "word", "total").groupBy("i").applyInArrow(block, BLOCK), "i")
    places = known.select(F.explode("at").alias("at"), "i", "r").select("at.chunk", "at.code", "i", "r")
    tiles = _files(cooccurrences(coded, places, window), "i", "j")
    drop_table(known)
    drop_table(coded)
    return Counts(spark, count, float(total), blocks, tiles)


def fit_word_vectors(
    tokens: DataFrame, column: str, size: int = 100, window: int = 5, min_count: int = 1, rounds: int = ROUNDS, staged: bool = True
) -> DataFrame:
    """(word, vector): ``rounds`` power iterations of the co-occurrence weights from hashed start vectors, averaged.

    The weight of two words is their positive pointwise mutual information, in shares per word; a word without any keeps itself.
    The counts stay sparse and distributed, in tiles of about ``TILE_WORDS`` words either way, and so do the words and their
    vectors, in the same blocks of words. They are staged once, compressed and each pair once, and weights are made from them
    as tiles are read. In a round the task of a block reads its tiles and the vectors of the other blocks one after the other
    and adds up its own words' vectors: no vector, weight or sum goes through a shuffle. All rounds but the last go over a few components at a time.
    The last is computed when the result is read; unless ``staged``, by every reader anew, for a reader that needs the vectors once.
    Texts are read whole, however long. The result depends on the texts alone, not on their order or partitions, but for rounding.
    """
    spark = tokens.sparkSession
    counts = word_counts(tokens, column, window, min_count)
    if counts is None:
        return spark.createDataFrame([], "word string, vector array<double>")
    step = size if counts.words * size * 4 <= START_BYTES else START_SIZE
    current = []
    for first in range(0, size, step):
        vectors = stage_table(_start_vectors(counts.blocks, first, min(step, size - first)), **PLAIN)
        for k in range(1, rounds):
            before, vectors = vectors, stage_table(_round(counts.parts([vectors]), counts.total, k == 1), **PLAIN)
            drop_table(before)
        current.append(vectors)
    found = _round(counts.parts(current, words=True), counts.total, rounds < 2, rounds, size)
    if not staged:
        return found
    found = spark.read.schema(found.schema).parquet(stage_path(found))
    for table in [*current, counts.blocks, counts.totals, counts.tiles]:
        drop_table(table)
    return found


def attach_vectors(df: DataFrame, vectors: DataFrame, key: str, size: int, out: str = "vector") -> DataFrame:
    """Vector of the row's word; a missing one is the zero vector."""
    lookup = vectors.select(F.col("word").alias(key), F.col("vector").alias(out))
    zero = F.array_repeat(F.lit(0.0), size)
    return attach(df, lookup, key, staged=True).withColumn(out, F.coalesce(F.col(out), zero))
