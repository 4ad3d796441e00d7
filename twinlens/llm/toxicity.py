"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insult, threat, target, negation, report or other. Three transducers mark an insult or threat
as negated, as reported speech and as aimed at someone; they are composed into one machine, which reads each clause
once. The marked hits of all clauses, weighted, give a logistic score. Insult stems beyond the seed lists and the weights are
learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import durable

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]+")
INPUTS = ("other", "insult", "threat", "target", "negation", "report", "end")

#: Seed words of each class.
SEEDS = {
    "insult": """idiot idiots idiotic stupid loser losers pathetic disgusting worthless moron morons scum clown trash garbage dumb fool
        imbecile jerk bastard bitch asshole freak vermin ugly idiota estúpido imbécil basura dummkopf trottel arschloch abschaum crétin
        connard salope débile""",
    "threat": """kill murder shoot stab strangle hang destroy hurt beat punch burn die töten umbringen schlagen tuer frapper matar golpear""",
    "target": """you your yours yourself he him his she her they them their u du dich dein ihr euch tu te vous votre vosotros usted ustedes""",
    "negation": """not no never neither nor without isn aren wasn don doesn didn won cannot nicht kein keine nie ne pas jamais no nunca ni sin""",
    "report": """said says say told tells claimed claims wrote writes quoted quotes reported reports called calls sagte sagt dit dijo dice""",
}

MARKS = ("negated", "reported", "aimed")
HITS = tuple((kind, *marks) for kind in ("insult", "threat") for marks in product((False, True), repeat=len(MARKS)))

SLICE_ROWS = 1_000
TRAIN_ROWS = 20_000  # labelled texts that lexicon and weights are learned from, at most
STEM_LENGTHS = (4, 5, 6, 7, 8, 10)
LEAST_TEXTS, LEAST_CONTEXTS, LEAST_PRECISION = 6, 6, 0.95
CACHE_SIZE = 300_000
TALLIED_STEMS = 50_000  # that a training task holds before it hands their counts on


class Transducer:
    """A finite-state machine that copies symbols and adds its mark to some: step(state, symbol) -> (state, symbol).

    A symbol is (class, marks). ``states`` lists all states, the first is the start.
    """

    def __init__(self, states: list, step: Callable):
        self.states, self.step = states, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: the output of this machine is the input of ``other``."""

        def step(state, symbol):
            left, middle = self.step(state[0], symbol)
            right, out = other.step(state[1], middle)
            return (left, right), out

        return Transducer([(a, b) for a in self.states for b in other.states], step)

    def compiled(self) -> tuple[list[list[int]], list[list[int]]]:
        """Tables over (state, input class): the next state, and the hit that is put out (-1: none). Only reachable states."""
        number, rows, hits, todo = {self.states[0]: 0}, [], [], [self.states[0]]
        for state in todo:
            row, out = [], []
            for kind in INPUTS:
                after, (cls, marks) = self.step(state, (kind, frozenset()))
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append(number[after])
                hit = (cls, *(m in marks for m in MARKS))
                out.append(HITS.index(hit) if hit in HITS else -1)
            rows.append(row)
            hits.append(out)
        return rows, hits


def _window(opener: str, mark: str, reach: int) -> Transducer:
    """Marks insults and threats up to ``reach`` words after ``opener`` in the same clause; reach 0: to the clause's end."""

    def step(state, symbol):
        kind, marks = symbol
        if kind == "end":
            return 0, symbol
        if kind == opener:
            return reach or 1, symbol
        if state and kind in ("insult", "threat"):
            symbol = (kind, marks | {mark})
        return (max(0, state - 1) if reach else state), symbol

    return Transducer(list(range(max(1, reach) + 1)), step)


def grammar() -> Transducer:
    """Negation, then reported speech, then target."""
    return _window("negation", "negated", 3).then(_window("report", "reported", 0)).then(_window("target", "aimed", 4))


class Lexicon(dict):
    """Word -> number of its class in INPUTS, by seed word or learned stem; remembers what it was asked, bounded."""

    def __init__(self, stems: frozenset[str] = frozenset()):
        super().__init__()
        self.stems = stems
        self.seeds = {w: INPUTS.index(kind) for kind, words in SEEDS.items() for w in words.split()}

    def __missing__(self, word: str) -> int:
        kind = self.seeds.get(word, 0)
        if not kind:
            if not word[0].isalpha():
                kind = INPUTS.index("end")
            elif any(word[:n] in self.stems for n in STEM_LENGTHS if len(word) >= n):
                kind = INPUTS.index("insult")
        if len(self) >= CACHE_SIZE:
            self.clear()
        self[word] = kind
        return kind


def hits_of(text: str, lexicon: Lexicon, machine: tuple[list[list[int]], list[list[int]]]) -> list[int] | None:
    """How often each of HITS is put out over all clauses; None if never."""
    classes = list(map(lexicon.__getitem__, TOKEN.findall(text.lower())))
    if 1 not in classes and 2 not in classes:
        return None
    rows, outs = machine
    counts, state = [0] * len(HITS), 0
    for kind in classes:
        hit = outs[state][kind]
        if hit >= 0:
            counts[hit] += 1
        state = rows[state][kind]
    return counts


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of at most ``most`` labelled rows that are not held out, chosen by hash; an id labelled twice counts as toxic if once."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return durable(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic")


def learn_stems(train: DataFrame) -> frozenset[str]:
    """Word beginnings that mark toxic texts.

    A stem must occur in enough toxic texts, hardly in others, and behind enough different words: copies of one toxic text
    repeat their contexts, words of abuse do not.
    """

    def tallied(found: dict[str, int], contexts: dict[str, set]) -> pa.RecordBatch:
        columns = [pa.array(list(found), pa.string()), *(pa.array([n >> shift & 0xFFFFFFFF for n in found.values()], pa.int64()) for shift in (0, 32))]
        columns.append(pa.array([list(contexts.get(s, ())) for s in found], pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays(columns, ["stem", "toxic", "clean", "contexts"])

    def tally(batches):
        found: dict[str, int] = {}  # toxic texts in the lower 32 bits, clean ones above
        contexts: dict[str, set] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, seen = [w for w in TOKEN.findall((text or "").lower()) if w[0].isalpha()], set()
                for before, word in zip(["", *words], words):
                    for n in STEM_LENGTHS:
                        if len(word) >= n:
                            stem = word[:n]
                            if stem not in seen:
                                seen.add(stem)
                                found[stem] = found.get(stem, 0) + (1 if toxic else 1 << 32)
                            if toxic:
                                before_it = contexts.setdefault(stem, set())
                                if len(before_it) < LEAST_CONTEXTS * 8:
                                    before_it.add(before)
                if len(found) >= TALLIED_STEMS:
                    yield tallied(found, contexts)
                    found, contexts = {}, {}
        yield tallied(found, contexts)

    counted = train.mapInArrow(tally, "stem string, toxic long, clean long, contexts array<string>").groupBy("stem")
    counted = counted.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.array_distinct(F.flatten(F.collect_list("contexts"))).alias("c"))
    contexts = F.size("c")
    kept = counted.where((F.col("toxic") >= LEAST_TEXTS) & (contexts >= LEAST_CONTEXTS) & (2 * contexts >= F.least("toxic", F.lit(LEAST_CONTEXTS * 8))))
    kept = kept.where(F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean")))
    return frozenset(r.stem for r in kept.select("stem").collect())


def prior_weights() -> np.ndarray:
    """Where the labels say nothing: hits count less when negated or reported, more when aimed; threats only when aimed."""
    weights = []
    for kind, negated, reported, aimed in HITS:
        w = {"insult": 3.0, "threat": 0.3}[kind] + {"insult": 0.7, "threat": 1.7}[kind] * aimed
        weights.append(w * (0.5 if negated else 1) * (0.5 if reported else 1))
    return np.array([*weights, -2.5])


def fit(counts: np.ndarray, toxic: np.ndarray, rows: np.ndarray, spread: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic weights around the prior by Newton steps; the last one is the intercept."""
    prior = prior_weights()
    x = np.hstack([np.log1p(counts), np.ones((len(counts), 1))])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (rows * (p - toxic)) + (w - prior) / spread**2
        curve = (x * (rows * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2
        step = np.linalg.solve(curve, slope)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Stems and weights; small and fixed in size by the training bound."""

    def __init__(self, stems: frozenset[str], weights: list[float]):
        self.stems, self.weights = stems, weights

    def score(self, counts: list[int] | None) -> float:
        total = self.weights[-1]
        if counts is not None:
            total += sum(w * math.log1p(n) for w, n in zip(self.weights, counts) if n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def train_model(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    train = training_rows(docs, labels, most)
    stems, machine = learn_stems(train), grammar().compiled()

    def features(batches):
        lexicon = Lexicon(stems)
        for batch in batches:
            hits = [hits_of(text or "", lexicon, machine) or [0] * len(HITS) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], ["hits", "toxic"])

    tallied = train.mapInArrow(features, "hits array<int>, toxic int").groupBy("hits", "toxic").agg(F.count(F.lit(1)).alias("n"))
    rows = tallied.orderBy("hits", "toxic").collect()  # at most ``most`` rows
    if not rows:
        return Model(stems, prior_weights().tolist())
    counts, toxic, n = (np.array([r[k] for r in rows], float) for k in ("hits", "toxic", "n"))
    return Model(stems, fit(counts, toxic, n).tolist())


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) and n_hits (marked insults and threats) of every whole text.

    A null or empty text has the score of a text without hits. Repeated rows and null ids stay, other columns are never
    read, an empty table gives no rows.
    """
    machine = grammar().compiled()
    told = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        lexicon = Lexicon(told.value.stems)
        for batch in batches:
            hits = [hits_of(text or "", lexicon, machine) for text in batch.column(1).to_pylist()]
            scores = [told.value.score(h) for h in hits]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            columns.append(pa.array([sum(h or ()) for h in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "n_hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, score double, predicted int, n_hits long")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is below 0.5.

    Null and empty texts have the score of a text without hits, repeated rows stay or go together, an empty table stays empty.
    """
    machine, text = grammar().compiled(), docs.columns.index("text")
    told = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches):
        lexicon = Lexicon(told.value.stems)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):  # so that few texts are Python strings at a time
                part = batch.slice(at, SLICE_ROWS)
                scores = [told.value.score(hits_of(t or "", lexicon, machine)) for t in part.column(text).to_pylist()]
                yield part.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
