"""Toxicity of texts by a weighted finite-state grammar over clauses.

Four transducers read the words of a clause one after the other:

* the lexical one turns words, stems and two-word phrases into classes (insult, threat, target, negation, reporting);
* the negation one cancels an insult or threat that follows a negation within ``SCOPE`` words;
* the reporting one halves what stands after a verb of saying, up to the end of the clause;
* the direction one raises an insult with a target within ``SCOPE`` words before or after it, and drops a threat
  without one. It guesses a target to come and fails if none does, so it is not deterministic.

The last three are tables of states and weighted arcs, composed once into one transducer: its states are
triples of theirs, and an arc's factor is the product of theirs. A clause weighs as much as the best path
through it. Clauses are scored, not single words, and a document's score is one logistic function of its clause
weights. The weights of words and of learned stems, and that function, are fitted on labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Hashable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcast.llm.base import id_remainder, map_slices
from eventcast.session import stage_table

# The words each class starts with; insults and threats gain learned words.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting",
           "imbecile", "filth", "vermin", "dumb", "bastard", "fool", "creep", "jerk")
THREATS = ("kill", "hurt", "destroy", "beat", "shoot", "stab", "burn", "hang", "punish")
PHRASES = {("shut", "up"): "insult", ("get", "lost"): "insult", ("drop", "dead"): "threat", ("beat", "up"): "threat",
           ("watch", "out"): "threat"}
TARGETS = ("you", "your", "you're", "youre", "he", "she", "they", "them", "him", "people", "everyone",
           "du", "dich", "euch", "ihr", "sie", "tu", "toi", "vous", "ils", "elles", "usted", "ustedes", "ellos")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "didn't", "without", "hardly",
             "nicht", "kein", "keine", "niemals", "jamais", "aucun", "aucune", "nunca", "jamás")
REPORTING = ("said", "says", "called", "wrote", "claimed", "quoted", "reported", "alleged", "accused",
             "sagte", "sagt", "schrieb", "nannte", "dit", "disait", "appelait", "dijo", "dice", "llamó")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(-1, 5)
LOADED = (INSULT, THREAT)
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)

SCOPE = 3  # words over which a negation or a target reaches
STEMS = range(5, 9)  # letters of a learned stem
WORD = re.compile(r"[^\W\d_]+(?:'[a-z]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]")
SAMPLE_DOCS = 30_000  # bound of the labelled sample

State = Hashable
Arc = tuple[State, int, float]  # next state, symbol written, factor of the symbol's weight


@dataclass(frozen=True)
class Transducer:
    """Arcs by (state, symbol read); paths must end in a state of ``finals``."""

    start: State
    finals: frozenset
    arcs: dict[tuple[State, int], tuple[Arc, ...]]


def negation_machine() -> Transducer:
    """The state counts the words that the last negation still covers."""
    arcs = {}
    for left in range(SCOPE + 1):
        for symbol in SYMBOLS:
            onward = SCOPE if symbol == NEGATION else max(left - 1, 0)
            cancelled = symbol in LOADED and left > 0
            arcs[left, symbol] = ((onward, OTHER if cancelled else symbol, 0.0 if cancelled else 1.0),)
    return Transducer(0, frozenset(range(SCOPE + 1)), arcs)


def reporting_machine() -> Transducer:
    """State 1 lies behind a verb of saying."""
    arcs = {}
    for behind in (0, 1):
        for symbol in SYMBOLS:
            arcs[behind, symbol] = ((int(behind or symbol == REPORT), symbol, 0.5 if behind and symbol in LOADED else 1.0),)
    return Transducer(0, frozenset((0, 1)), arcs)


def direction_machine() -> Transducer:
    """States (seen, promised): words that the last target still reaches, words within which a promised one must come."""
    arcs = {}
    for seen in range(SCOPE + 1):
        for promised in range(SCOPE + 1):
            for symbol in SYMBOLS:
                onward = SCOPE if symbol == TARGET else max(seen - 1, 0)
                if symbol == TARGET:
                    kept = 0
                elif promised == 1:
                    continue  # the promise is broken
                else:
                    kept = max(promised - 1, 0)
                near = 1.25 if symbol == INSULT else 1.0
                if symbol not in LOADED:
                    found = [((onward, kept), symbol, 1.0)]
                elif seen or kept:
                    found = [((onward, kept), symbol, near)]
                else:
                    found = [((onward, 0), symbol, 1.0 if symbol == INSULT else 0.0), ((onward, SCOPE), symbol, near)]
                arcs[(seen, promised), symbol] = tuple(found)
    return Transducer((0, 0), frozenset((seen, 0) for seen in range(SCOPE + 1)), arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer whose paths are those of ``first`` with what they write read by ``second``."""
    start = (first.start, second.start)
    arcs, waiting, met = {}, [start], {start}
    while waiting:
        state = waiting.pop()
        for symbol in SYMBOLS:
            found = tuple(((a, b), out, f * g) for a, middle, f in first.arcs.get((state[0], symbol), ())
                          for b, out, g in second.arcs.get((state[1], middle), ()))
            if found:
                arcs[state, symbol] = found
                fresh = {arc[0] for arc in found} - met
                met |= fresh
                waiting += fresh
    return Transducer(start, frozenset(s for s in met if s[0] in first.finals and s[1] in second.finals), arcs)


def best_path(machine: Transducer, events: list[tuple[int, float]]) -> float:
    """Largest sum of weights times factors over all accepted paths of (symbol, weight) events; 0 if there is none."""
    reached = {machine.start: 0.0}
    for symbol, weight in events:
        onward: dict[State, float] = {}
        for state, total in reached.items():
            for target, _, factor in machine.arcs.get((state, symbol), ()):
                value = total + weight * factor
                if value > onward.get(target, -1.0):
                    onward[target] = value
        reached = onward
    return max((v for s, v in reached.items() if s in machine.finals), default=0.0)


SCOPES = compose(compose(negation_machine(), reporting_machine()), direction_machine())


@dataclass
class Grammar:
    """``lexicon``: word -> (class, weight); ``stems``: first letters -> weight of an insult; ``line``: slope terms of
    the document score."""

    lexicon: dict[str, tuple[int, float]]
    stems: dict[str, float] = field(default_factory=dict)
    line: tuple[float, float, float] = (-3.0, 1.5, 1.0)

    def __post_init__(self):
        self.loaded = {w for w, (kind, _) in self.lexicon.items() if kind in LOADED} | {w for w, _ in PHRASES}
        self.heads = {stem[:STEMS[0]] for stem in self.stems}

    def may_weigh(self, words: list[str]) -> bool:
        """Whether any of the words could be loaded, begin a phrase or have a known stem."""
        return not (self.loaded.isdisjoint(words) and (not self.heads or self.heads.isdisjoint([w[:STEMS[0]] for w in words])))

    def read(self, word: str) -> tuple[int, float]:
        """Class and weight of a word: its own, else those of its longest known stem."""
        if word in self.lexicon:
            return self.lexicon[word]
        for size in reversed(STEMS) if self.stems else ():
            if word[:size] in self.stems:
                return INSULT, self.stems[word[:size]]
        return OTHER, 0.0


def lexical(words: list[str], grammar: Grammar) -> list[tuple[int, float]]:
    """The lexical transducer: (class, weight) of every word; it waits one word for the end of a phrase.

    Its state is the word before. The first word of a phrase gives nothing, the second the phrase's class.
    """
    events, before = [], None
    for word in words:
        kind = PHRASES.get((before, word))
        if kind is not None:
            events[-1] = (OTHER, 0.0)
            events.append((INSULT, 2.0) if kind == "insult" else (THREAT, 1.5))
        else:
            events.append(grammar.read(word))
        before = word
    return events


def clause_weights(text: str, grammar: Grammar) -> list[float]:
    """Weights of the clauses that hold a loaded word; ``text`` is in lower case."""
    out = []
    for clause in CLAUSE_END.split(text):
        words = WORD.findall(clause)
        if not grammar.may_weigh(words):
            continue
        events = lexical(words, grammar)
        if any(kind in LOADED for kind, _ in events):
            out.append(best_path(SCOPES, events))
    return out


def features(text: str | None, grammar: Grammar) -> tuple[float, float]:
    """Strongest clause and the logarithm of the sum; both 0 without a weighted clause."""
    found = clause_weights((text or "").lower(), grammar)
    return (min(max(found), 6.0), math.log1p(sum(found))) if found else (0.0, 0.0)


def score(text: str | None, grammar: Grammar) -> float:
    a, b, c = grammar.line
    x, y = features(text, grammar)
    return 1.0 / (1.0 + math.exp(-(a + b * x + c * y)))


def base_lexicon() -> dict[str, tuple[int, float]]:
    lexicon = {w: (INSULT, 2.0) for w in INSULTS} | {w: (THREAT, 1.5) for w in THREATS}
    for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING)):
        lexicon |= {w: (kind, 0.0) for w in words}
    return lexicon


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Written table (text, toxic) of about ``sample`` labelled documents at most, taken by a hash of the id.

    A document with several differing labels takes the largest. The sampled labels are bounded by
    ``sample``, so they are broadcast and the texts are not shuffled.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    total = marks.count()
    if total > sample:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    return stage_table(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic"))


def train(rows: DataFrame, min_docs: int = 4, min_log_odds: float = 3.0, min_stem_docs: int = 3, min_forms: int = 3) -> Grammar:
    """Grammar fitted on labelled rows (text, toxic 0/1), a bounded sample that is read several times.

    Rows with a null text or label are left out. Document frequencies are counted by Spark on three
    quarters of the texts; a word found in ``min_docs`` toxic ones or more with high log odds joins the insults,
    as does a stem found in ``min_stem_docs`` of them in ``min_forms`` words or more, and the weight of a listed word follows
    its odds where it was seen. The last quarter,
    on which no word was learned, fits the document score.
    """
    rows = rows.filter("text is not null and toxic is not null").select(
        F.lower("text").alias("text"), "toxic", (F.pmod(F.xxhash64("text"), F.lit(4)) == 3).alias("apart"),
        F.monotonically_increasing_id().alias("row"))
    good = rows.filter("not apart")
    grammar = Grammar(base_lexicon())
    size = {r["toxic"]: r["count"] for r in good.groupBy("toxic").count().collect()}
    bad, fine = size.get(1, 0), size.get(0, 0)
    if not bad or not fine:
        return grammar
    def odds_of(texts_with: int, fine_with: int) -> float:
        return math.log((texts_with + 0.5) / bad) - math.log((fine_with + 0.5) / fine)

    words = good.select("toxic", F.explode(F.array_distinct(F.split("text", r"[^\p{L}']+"))).alias("word"), "row")
    seen = words.filter(F.length("word") > 2).groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
    # The sample bounds the words, too.
    for r in seen.filter(F.col("bad") >= min_docs).collect():
        odds = odds_of(r["bad"], r["fine"])
        kind = grammar.lexicon.get(r["word"], (None, 0.0))[0]
        if kind in LOADED:
            grammar.lexicon[r["word"]] = (kind, min(max(odds / 2, 0.0), 3.0))
        elif kind is None and odds >= min_log_odds:
            grammar.lexicon[r["word"]] = (INSULT, min(odds / 2, 3.0))
    cut = F.transform(F.array(*[F.lit(n) for n in STEMS]), lambda n: F.when(F.length("word") >= n, F.substring(F.col("word"), F.lit(1), n)))
    stems = words.select("row", "toxic", "word", F.explode(F.filter(cut, lambda p: p.isNotNull())).alias("stem"))
    mark = F.when(F.col("toxic") == 1, F.col("row"))
    stems = stems.groupBy("stem").agg(
        F.count_distinct(mark).alias("bad"), F.count_distinct(F.when(F.col("toxic") == 0, F.col("row"))).alias("fine"),
        F.count_distinct(F.when(F.col("toxic") == 1, F.col("word"))).alias("forms"))
    for r in stems.filter((F.col("bad") >= min_stem_docs) & (F.col("forms") >= min_forms)).collect():
        odds = odds_of(r["bad"], r["fine"])
        if odds >= min_log_odds and r["stem"] not in grammar.lexicon:
            grammar.stems[r["stem"]] = min(odds / 2, 3.0)
    grammar = Grammar(grammar.lexicon, grammar.stems)
    measured = _measure(rows.filter("apart"), grammar).groupBy("x", "y", "toxic").count().collect()
    return Grammar(grammar.lexicon, grammar.stems, _logistic(measured))


def _measure(rows: DataFrame, grammar: Grammar) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t, grammar) for t in batch.column("text").to_pylist()]
            x, y = (pa.array([round(f[i], 1) for f in found], pa.float64()) for i in (0, 1))
            return pa.RecordBatch.from_arrays([x, y, batch.column("toxic")], names=["x", "y", "toxic"])

        return work

    return map_slices(rows.select("text", "toxic"), "text", make, "x double, y double, toxic int")


def _logistic(rows: list, rounds: int = 30) -> tuple[float, float, float]:
    """Newton steps on (x, y, toxic, count) rows, a little ridge."""
    rows = sorted(rows, key=lambda r: (r["x"], r["y"], r["toxic"]))
    a = np.array([[1.0, r["x"], r["y"]] for r in rows])
    t = np.array([float(r["toxic"]) for r in rows])
    n = np.array([float(r["count"]) for r in rows])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.array([0.01, 1.0, 1.0])
        slope = a.T @ (n * (t - p)) - ridge * w
        bend = (a * (n * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        w = w + np.linalg.solve(bend, slope)
    return float(w[0]), float(w[1]), float(w[2])


def judge(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row; null and empty texts get the score of no clause."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = np.array([score(t, grammar) for t in batch.column("text").to_pylist()])
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

        return work

    return map_slices(docs.select("doc_id", "text"), "text", make, f"doc_id {kind}, score double, predicted int")


def held_out():
    """Documents kept from training: crc32 of the id modulo 4 is 2."""
    return id_remainder(F.col("doc_id"), 4) == 2


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns the labels of documents that are not held out."""
    grammar = train(labelled_sample(docs, labels.filter(~held_out())))
    return judge(docs, grammar).select("doc_id", held_out().alias("held_out"), "score", "predicted")
