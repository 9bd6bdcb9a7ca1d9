"""Secrets in texts: fixed patterns, and random strings shown by a low number of characters per token.

A vocabulary learned from written language covers words and names with few tokens, random strings
with many. A run of code characters is reported when the vocabulary needs many tokens for it and it is
neither a known digest nor an identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass, field

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from eventcast.llm.base import joined_spans, map_slices

# Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
WORDS = re.compile(r"[A-Za-z]+|[0-9]+")


@dataclass(frozen=True)
class Rules:
    """``max_ratio``: characters per token at or below which a run counts as random;
    ``digest_sizes``: lengths of hexadecimal runs that are digests of files or commits;
    ``vocabulary``: the public rank file whose tokens are counted."""

    max_ratio: float = 1.9
    digest_sizes: tuple[int, ...] = (32, 40, 48, 56, 64, 96, 128)
    vocabulary: str = field(default_factory=lambda: public_tokenizers.path("byte_bpe_50k.tiktoken"))


def load_encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known_kind(run: str, rules: Rules) -> bool:
    """A run that only looks random: a digest, a UUID, a number, or an identifier made of words.

    An identifier has at most one change between letters and digits per word part, mixes no case
    inside a part other than a leading capital, and its letters make up most of it.
    """
    if DIGEST.fullmatch(run):
        return len(run) in rules.digest_sizes or run.isdigit()
    if UUID.fullmatch(run):
        return True
    parts = WORDS.findall(run)
    letters = sum(len(p) for p in parts if not p.isdigit())
    if not any(c.isdigit() for c in run):
        # words, paths, camel case: capitals only where a part begins
        humps = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", run)
        return len(humps) * 3 <= letters or letters * 2 < len(run)
    humps = re.findall(r"[A-Z]?[a-z]+|[A-Z]{2,}|[0-9]+", run)
    return len(humps) * 4 <= len(run)


def find_secrets(text: str, encoding: tiktoken.Encoding, rules: Rules) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points; base kinds first found by pattern, then random runs that
    overlap none of them."""
    spans = []
    if "=" in text or ":" in text:
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = list(spans)
    for m in RUN.finditer(text):
        run = m[0]
        if known_kind(run, rules) or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if len(run) <= rules.max_ratio * len(encoding.encode_ordinary(run)):
            spans.append((m.start(), 3, m.end()))
    return spans


def scan(docs: DataFrame, rules: Rules | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, the digest of the base spans and all spans as text.

    A null text is an empty one and has no span; other columns of ``docs`` are not read; repeated
    rows give repeated results.
    """
    rules = rules or Rules()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = (f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
              "n_random long")

    def make():
        encoding = load_encoding(rules.vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, spans = [[], [], [], []], [], []
            for value in batch.column("text").to_pylist():
                found = find_secrets(value or "", encoding, rules)
                for k in range(4):
                    counts[k].append(sum(1 for s in found if s[1] == k))
                base = joined_spans([s for s in found if s[1] < 3], KINDS)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(joined_spans(found, KINDS))
            columns = [pa.array(c, pa.int64()) for c in counts]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns[:3], pa.array(digests), pa.array(spans), columns[3]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

        return work

    return map_slices(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "text", make, schema)
