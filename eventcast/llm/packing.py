"""Packing documents into sequences of a fixed number of tokens by a plan over the length histogram.

The plan sees only how many pieces there are of each length (at most as many counts as a sequence has
tokens) and fills sequences by best fit, longest pieces first, whole groups of equal sequences at a time.
Pieces then take the planned slots by their rank among the pieces of the same length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from eventcast.llm.base import slices
from eventcast.llm.secrets import load_encoding
from eventcast.session import stage, stage_table

SEQUENCE = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary
CACHED_WORDS = 300_000  # kept per task; the cache starts anew beyond it
LONGEST_CACHED = 64
# A blank before one of these always begins a new word of the vocabulary's pattern.
FIRST = re.compile(r"[!-~À-ÖØ-öø-ɏ]")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ɏ]+")
PLAIN_TEXT = re.compile(r"[\n -~À-ÖØ-öø-ɏ]*")
LONG_TEXT = 1 << 20  # characters encoded in one call
BEFORE_WORD = re.compile(f" (?={FIRST.pattern})")


class Encoder:
    """Token ids as little-endian 32-bit bytes, equal to encoding the whole text at once.

    Texts of Latin letters, ASCII signs, blanks and line feeds, whose classes no library disputes, go through
    the rank form of the same vocabulary where ``ranks`` names it. Long ones are cut before blanks that begin a word, where
    the vocabulary's own pattern always cuts. Other texts are cut at all such blanks, so that each part is encoded
    once and remembered, and only words with other signs need the slower form.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.fast = load_encoding(ranks).encode_ordinary if ranks else None
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cache: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _plain(self, text: str) -> bytes:
        at, ids = 0, []
        while len(text) - at > LONG_TEXT and (cut := BEFORE_WORD.search(text, at + LONG_TEXT)):
            ids.append(np.array(self.fast(text[at:cut.start()]), "<u4").tobytes())
            at = cut.start()
        ids.append(np.array(self.fast(text[at:] if at else text), "<u4").tobytes())
        return b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.fast is not None and PLAIN_TEXT.fullmatch(t) is not None and not any(s in t for s in self.special)
                 for t in texts]
        others = iter(self._by_words([t for t, p in zip(texts, plain) if not p]))
        return [self._plain(t) if p else next(others) for t, p in zip(texts, plain)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        parts: list[list[str] | None] = []
        for text in texts:
            if any(s in text for s in self.special):
                parts.append(None)
                continue
            cut = text.split(" ")
            if "" in cut or any(not FIRST.match(w) for w in {w[0] for w in cut[1:]}):
                cut = BEFORE_WORD.split(text)
            parts.append(cut)
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        known = self.cache
        wanted = {w for p in parts if p for w in p[1:]}.difference(known)
        fresh = {}
        if self.fast:
            fresh = {w: np.array(self.fast(" " + w), "<u4").tobytes() for w in wanted if PLAIN.fullmatch(w)}
            wanted = wanted.difference(fresh)
        wanted = list(wanted)
        fresh |= zip(wanted, self._whole([" " + w for w in wanted]))
        known.update((w, ids) for w, ids in fresh.items() if len(w) <= LONGEST_CACHED)
        heads = iter(self._whole([p[0] if p else t for p, t in zip(parts, texts)]))
        out = []
        for p in parts:
            head = next(heads)
            if not p or len(p) == 1:
                out.append(head)
            else:
                try:
                    out.append(head + b"".join([known[w] for w in p[1:]]))
                except KeyError:
                    out.append(head + b"".join([known.get(w) or fresh[w] for w in p[1:]]))
        return out


def cut_lengths(tokens: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of a document's pieces: whole sequences, after a first shorter one if need be."""
    if tokens <= sequence:
        return [tokens]
    return [tokens % sequence] * (tokens % sequence > 0) + [sequence] * (tokens // sequence)


def tokenize(
    docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """Written table of pieces: doc_id, piece, start, length, ids_crc32, task and rank within task and length.

    A null text is an empty one: its only token is ``end_id``. ``keep_ids`` adds the ids themselves
    (binary, little-endian 32 bits). Repeated rows are packed as often as they occur.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    ranks = None if vocabulary else public_tokenizers.path(RANKS)
    end = np.array([end_id], "<u4").tobytes()
    schema = docs.select("doc_id").schema
    for name, t in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"),
                    ("_task", "integer"), ("_nth", "long")):
        schema = schema.add(name, t)
    if keep_ids:
        schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks)
        seen = np.zeros(sequence + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text"):
                owner, rows, blobs = [], [], []
                for i, ids in enumerate(encoder.encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    start = 0
                    for piece, length in enumerate(cut_lengths(len(ids) // 4, sequence)):
                        blob = ids[4 * start: 4 * (start + length)]
                        rows.append((piece, start, length, zlib.crc32(blob), task, int(seen[length])))
                        seen[length] += 1
                        owner.append(i)
                        start += length
                        if keep_ids:
                            blobs.append(blob)
                columns = list(zip(*rows))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                arrays = [part.column("doc_id").take(pa.array(owner))]
                arrays += [pa.array(c, t) for c, t in zip(columns, types)]
                if keep_ids:
                    arrays.append(pa.array(blobs, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return stage_table(docs.select("doc_id", "text").mapInArrow(run, schema))


def plan_slots(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: rows (length, first rank, end rank, first sequence, offset).

    Ranks ``first .. end - 1`` of that length go to consecutive sequences at the same offset. Groups of
    sequences filled alike are kept by the room they have left; a length takes the group with the least
    room that holds it, as many copies per sequence as fit.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    rooms: list[int] = []
    opened = 0

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first = sequence, opened
                number = -(-left // (sequence // length))
                opened += number
            copies = room // length
            filled = min(number, left // copies)
            if not filled:  # the last few share one sequence
                filled, copies = 1, left
            for c in range(copies):
                rows.append((length, rank, rank + filled, first, sequence - room + c * length))
                rank += filled
            left -= copies * filled
            put(room - copies * length, first, filled)
            put(room, first + filled, number - filled)
    return rows


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of ``tokenize`` with ``sequence_id`` and ``offset``; sequences are gapless from 0.

    The histogram that reaches the driver has at most ``sequence`` rows. The plan is broadcast: it has a
    few rows per pair of a length and a group, whatever the number of documents.
    """
    spark: SparkSession = pieces.sparkSession
    per_task = stage(pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = plan_slots(counts, sequence)
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["length", "_task"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    names = ["_length", "_first", "_end", "_sequence", "_offset"]
    columns = zip(*rows) if rows else [[]] * 5
    plan = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=names))
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    placed = ranked.join(F.broadcast(plan), fits)
    own = [c for c in pieces.columns if c not in ("_task", "_nth")]
    return placed.select(*own, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"),
                         F.col("_offset").alias("offset"))


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID,
         keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document."""
    return pack_pieces(tokenize(docs, vocabulary, sequence, end_id, keep_ids), sequence)
