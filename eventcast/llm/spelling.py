"""Groups of spelling variants: words one edit apart, each drawn to a much more frequent neighbour.

The vocabulary is cut into blocks, each with a bit-sliced position index: one bitset over the block's words per
(position, letter). A query word is read letter by letter against all words of a block at once. Four sets move along:
no error so far, one letter replaced (same position), one letter of the query too many (position shifted back) and one
letter missing from it (position shifted forward); a step is a handful of ANDs and ORs on whole machine words.

Two words one edit apart share their first or their last ``(length - 1) // 2`` letters, so a word meets only the blocks
of its own beginnings and endings. Cells with more words than a block, however many share a key, become a grid of blocks of
bounded size. Every pair is counted once: by its beginning, or by its ending where the beginnings differ.

Null texts hold no words, a null id counts as the empty text, texts of any length are read whole, and an empty table gives
no rows. Texts and ids that repeat count each time. Order of words is by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcast.operators.attach import attach
from eventcast.session import stage, stage_table

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 97  # one run in so many loses a letter
SHORTEST = 5
RAREST = 3
DOMINANCE = 2  # a form is at least so many times as frequent
BLOCK_LETTERS = 1 << 14
TASK_WORDS = 1 << 18  # 64-bit words of one set in a batch of queries


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, less one letter chosen by its checksum where that is divisible by ``SLIP``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(SLIP)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
                  ).otherwise(run)


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n): runs of letters of whole texts, counted before the shuffle."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    words = docs.select(F.col("doc_id"), F.explode(runs).alias("run"))
    words = words.filter(F.length("run") >= shortest).select(slipped(F.col("doc_id"), F.col("run")).alias("word"))
    words = words.filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rarest)


# --- the index ------------------------------------------------------------------------------

class Index:
    """Bitsets over a block of words: one per (position, letter) that occurs, one per length."""

    def __init__(self, words: list[str]):
        sizes = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        position = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.alphabet = np.unique(letters)
        self.longest = int(sizes.max(initial=0))
        self.width = max(1, -(-len(words) // 64))
        wide = len(self.alphabet) + 1
        cells, row = np.unique(position * wide + np.searchsorted(self.alphabet, letters), return_inverse=True)
        # Row 0 is the empty set, for letters that stand at a position of no word.
        self.rows = np.zeros((len(cells) + 1, self.width), np.uint64)
        bit = np.left_shift(np.uint64(1), (owner % 64).astype(np.uint64))
        np.bitwise_or.at(self.rows, (row + 1, owner // 64), bit)
        self.cells = cells
        self.of_length = {}
        for size in np.unique(sizes).tolist():
            self.of_length[size] = self._set(np.flatnonzero(sizes == size))
        self.all = self._set(np.arange(len(words)))

    def _set(self, members: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(out, members // 64, np.left_shift(np.uint64(1), (members % 64).astype(np.uint64)))
        return out

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """Per query, the words with its letter at ``position``."""
        if not 0 <= position < self.longest:
            return np.zeros((len(letters), self.width), np.uint64)
        wide = len(self.alphabet) + 1
        code = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        cell = np.where(self.alphabet[code] == letters, position * wide + code, -1)
        row = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return self.rows[np.where(self.cells[row] == cell, row + 1, 0)]

    def near(self, queries: np.ndarray) -> np.ndarray:
        """Bitsets of the words exactly one edit from each query; ``queries``: equal lengths, one row of letters each."""
        count, size = queries.shape
        nothing = np.zeros((count, self.width), np.uint64)
        exact = np.broadcast_to(self.all, nothing.shape).copy()
        replaced, extra, missing = nothing, nothing, exact  # before the first letter only a word's letter can be skipped
        back, here = nothing, self.at(0, queries[:, 0])
        for j in range(size):
            letter = queries[:, j]
            ahead = self.at(j + 1, letter)
            if j:
                back, here = self.at(j - 1, letter), self.at(j, letter)
            replaced = (replaced & here) | (exact & ~here)
            extra = (extra & back) | exact
            exact = exact & here
            missing = (missing & ahead) | exact
        found = nothing.copy()
        for sets, length in ((replaced, size), (extra, size - 1), (missing, size + 1)):
            if length in self.of_length:
                found |= sets & self.of_length[length]
        return found


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of every set bit."""
    query, place = np.nonzero(sets)
    bits = np.unpackbits(sets[query, place].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pair, bit = np.nonzero(bits)
    return query[pair], place[pair] * 64 + bit


def _codes(words: pa.Array, others: pa.Array, start: int, stop: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal slices of two lists of words."""
    both = pc.utf8_slice_codeunits(pa.concat_arrays([words, others]), start, stop)
    codes = both.dictionary_encode().indices.to_numpy()
    return codes[: len(words)], codes[len(words):]


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _near_of_cell(cell: pa.Table) -> pa.Table:
    """(word, near words, largest n among them and its word) for the queries of one cell of the grid."""
    ending, share = cell["ending"][0].as_py(), (cell["length"][0].as_py() - 1) // 2
    is_query = cell["is_query"].combine_chunks()
    held = cell.filter(pc.invert(is_query)).sort_by([("n", "descending"), ("word", "ascending")])
    asked = cell.filter(is_query)
    if not len(held) or not len(asked):
        return NEAR.empty_table()
    words, queries = held["word"].combine_chunks(), asked["word"].combine_chunks()
    index = Index(words.to_pylist())
    counts = held["n"].to_numpy()
    heads = _codes(words, queries, 0, share)
    tails = _codes(words, queries, -share, None)
    sizes = pc.utf8_length(queries).to_numpy()
    out = []
    batch = max(1, TASK_WORDS // index.width)
    for size in np.unique(sizes).tolist():
        of_size = np.flatnonzero(sizes == size)
        for start in range(0, len(of_size), batch):
            part = of_size[start:start + batch]
            text = "".join(queries.take(pa.array(part)).to_pylist())
            letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(part), size)
            query, word = _members(index.near(letters))
            query = part[query]
            same_head = heads[1][query] == heads[0][word]
            mine = ~same_head & (tails[1][query] == tails[0][word]) if ending else same_head
            query, word = query[mine], word[mine]
            # Words stand by falling n, then by code point: the first of a query is its best.
            order = np.lexsort((word, query))
            query, word = query[order], word[order]
            first = np.flatnonzero(np.diff(query, prepend=-1))
            out.append((query[first], np.diff(np.append(first, len(query))), word[first]))
    query, many, best = (np.concatenate(x) for x in zip(*out))
    return pa.table([queries.take(pa.array(query)), pa.array(many, pa.int64()), pa.array(counts[best], pa.int64()),
                     words.take(pa.array(best))], schema=NEAR)


def near_words(words: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, n_near, best_n, best) for the words of (word, n) that have a word one edit away."""
    length = F.length("word")
    sides = F.explode(F.array(F.lit(False), F.lit(True))).alias("ending")
    held = words.select("word", "n", length.alias("length"), sides, F.lit(False).alias("is_query"))
    asked = words.select("word", F.lit(0).cast("long").alias("n"), F.explode(F.sequence(length - 1, length + 1)).alias("length"),
                         F.lit(True).alias("is_query")).select("word", "n", "length", sides, "is_query")
    known = stage(words.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("words")))
    share = F.floor((F.col("length") - 1) / 2).cast("int")
    key = F.when(F.col("ending"), F.substring("word", -share, share)).otherwise(F.substring("word", F.lit(1), share))
    block = F.greatest(F.lit(64), F.floor(F.lit(block_letters) / F.col("length")))
    cells = F.ceil(F.col("words") / block).cast("long")
    # Lengths that no word has need no queries.
    placed = attach(held.unionByName(asked), known, "length", "inner", staged=True)
    placed = stage_table(placed.withColumn("cell", F.pmod(F.xxhash64(key), cells)).select(
        "ending", "length", "cell", "is_query", "word", "n"))
    sizes = placed.groupBy("ending", "length", "cell").agg(F.count_if(~F.col("is_query")).alias("_held"), F.count_if("is_query").alias("_asked"))
    grid = sizes.filter("_held > 0 AND _asked > 0").select(
        "ending", "length", "cell", F.ceil(F.col("_held") / (2 * block)).cast("int").alias("_blocks"),
        F.ceil(F.col("_asked") / (8 * block)).cast("int").alias("_batches"))
    placed = attach(placed, grid, ["ending", "length", "cell"], "inner")
    mine = F.pmod(F.xxhash64("word"), F.when(F.col("is_query"), F.col("_batches")).otherwise(F.col("_blocks"))).cast("int")
    copies = F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("_blocks")).otherwise(F.col("_batches")) - 1)
    placed = placed.withColumn("_mine", mine).withColumn("_other", F.explode(copies))
    block_of = F.when(F.col("is_query"), F.col("_other")).otherwise(F.col("_mine")).alias("block")
    batch_of = F.when(F.col("is_query"), F.col("_mine")).otherwise(F.col("_other")).alias("batch")
    placed = placed.select("ending", "length", "cell", block_of, batch_of, "is_query", "word", "n")
    found = placed.groupBy("ending", "length", "cell", "block", "batch").applyInArrow(
        _near_of_cell, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", (-F.col("_best.least")).alias("best_n"), F.col("_best.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling the steps; links (word, form) has no cycle."""
    jumps = stage(links.select("word", F.col("form").alias("root")))
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumps = stage(attach(jumps, onward, "root", staged=True).select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if not jumps.filter("_moved").limit(1).count():
            return jumps.select("word", "root")
        jumps = jumps.drop("_moved")


def variants(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a staged vocabulary (word, n).

    ``form``: the most frequent word one edit away (ties: the smallest) where it is at least ``dominance`` times as frequent
    as the word. Frequencies at least double along forms, so chains are short.
    """
    found = stage_table(attach(words, near_words(words), "word"))
    drawn = F.col("best_n") >= dominance * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                         F.when(drawn, F.col("best")).alias("form"), F.when(drawn, F.col("best_n")).alias("form_n"))
    ends = roots(found.filter(F.col("form").isNotNull()).select("word", "form"))
    found = attach(found, ends, "word", staged=True)
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """The spelling variants of all texts of ``docs`` (doc_id, text)."""
    return variants(stage_table(vocabulary(docs)))
