"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns each word into a symbol, the classes that the word is of, with a weight. Five
transducers read a clause's symbols, each what the one before it has written: targets mark
the words of a clause that names a target, before or after them (two paths are guessed, and only the
right one is accepted); negation marks the words that it reaches; reported speech marks those after
its verb; insults and threats write the kind of a match, with a share of the word's weight
for each kind. They are composed into one machine when this module is imported. A clause is scored by its
accepted path. A document's matches, summed by kind, and its heaviest clause go to a logistic
regression whose weights start from priors, so what a negated or reported insult is worth is
learned where there are any and small elsewhere.

Closed classes (pronouns, negators, verbs of speech and of harm) are listed below. Insults are
learned: a word or stem is an arc if labelled documents that hold it are toxic beyond
chance, by a likelihood ratio above a bound that grows with the number of forms tested.
All training rows are counted; equal texts count once. Weights are fitted on a bounded
sample of distinct training texts, each read with arcs learned from the other folds and
weighted by its rows.

A null or empty text matches nothing and gets the score of a text without matches. Without
training labels of both kinds every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from heatlens.llm.common import BROADCAST_ROWS, chunks, text_of
from heatlens.llm.transducers import Transducer, best_path, cascade, machine, outputs

# Closed word classes of the four languages, lower case.
TARGETS = "you your yours he she they them him her us this that tu toi vous ton ta votre vos il elle eux du dich dir ihr euch dein deine er sie usted ustedes te ti él ella ellos ese eso"
NEGATORS = "not no never neither nor without cannot pas jamais aucun sans ne nicht kein keine nie niemals ohne nunca jamás sin tampoco ni"
REPORTERS = "said says told called claimed wrote asked quoted dit disait écrit appelé sagte sagt nannte schrieb rief dijo dice llamó escribió preguntó"
THREATS = "kill hurt destroy murder strangle shoot stab punch tuer frapper détruire töten schlagen erschießen zerstören umbringen matar golpear destruir disparar"

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
# A negation covers this many words after it.
NEGATION_REACH = 3
STEMS = (4, 5)
# The weights are fitted on about this many distinct labelled texts at most.
SAMPLE_DOCS = 20_000
# A row's features for the fit come from arcs learned without the row's fold.
FOLDS = 5
# A worker remembers so many words, up to so long, that match nothing; then it starts anew.
PLAIN_WORDS = 1 << 18
PLAIN_LENGTH = 40
KINDS = ("plain", "targeted", "negated", "reported", "threat")
# What a match of each kind passes on of its word's weight. What all matches pass on has weights of its
# own in the regression; a kind adds its difference from a plain match, which starts from a prior.
SHARES = {"plain": 1.0, "targeted": 1.25, "negated": 0.25, "reported": 0.4, "threat": 1.5}
PRIORS = {"targeted": 0.2, "negated": -0.2, "reported": -0.1, "threat": 0.4}
THREAT_WEIGHT = 1.0
# Forms and number of the matches that are neither negated nor reported, the weight of all paths, the
# heaviest path, clauses with such matches, and whether there are two forms; then weight and number by kind.
SHARED = 6
WIDTH = SHARED + 2 * len(PRIORS)

# Classes of a word, and marks that machines add.
TARGET, NEGATOR, REPORTER, THREAT, INSULT, TARGETED, NEGATED, REPORTED = (1 << k for k in range(8))
MATCH = 1 << 8
WORDS = range(32)


def _kind(symbol: int, kind: str) -> int:
    return symbol % MATCH + MATCH * (1 + KINDS.index(kind))


def target_machine() -> Transducer:
    """Marks every word of a clause that names a target. ``none`` holds that there is no target in
    it, ``ahead`` that one is to come; the clause accepts one of them."""

    def step(state: str, word: int) -> list:
        if state == "none":
            return [] if word & TARGET else [("none", word, 1.0)]
        return [("seen" if state == "seen" or word & TARGET else "ahead", word | TARGETED, 1.0)]

    return machine(["none", "ahead"], ["none", "seen"], WORDS, step)


def negation_machine(inputs: set[int]) -> Transducer:
    def step(reach: int, word: int) -> list:
        return [(NEGATION_REACH if word & NEGATOR else max(0, reach - 1), word | NEGATED if reach else word, 1.0)]

    return machine([0], range(NEGATION_REACH + 1), inputs, step)


def report_machine(inputs: set[int]) -> Transducer:
    def step(told: bool, word: int) -> list:
        return [(told or bool(word & REPORTER), word | REPORTED if told else word, 1.0)]

    return machine([False], [False, True], inputs, step)


def insult_machine(inputs: set[int]) -> Transducer:
    def step(state: int, word: int) -> list:
        if not word & INSULT:
            return [(0, word, 1.0)]
        kind = "negated" if word & NEGATED else "reported" if word & REPORTED else "targeted" if word & TARGETED else "plain"
        return [(0, _kind(word, kind), SHARES[kind])]

    return machine([0], [0], inputs, step)


def threat_machine(inputs: set[int]) -> Transducer:
    """Writes the kind of the match alone: 0 for none, else its place in ``KINDS`` from 1."""

    def step(state: int, word: int) -> list:
        if word & THREAT and word & TARGETED and not word & (NEGATED | REPORTED):
            insult = SHARES["targeted"] if word & INSULT else 1.0
            return [(0, 1 + KINDS.index("threat"), SHARES["threat"] / insult)]
        return [(0, word // MATCH, 1.0)]

    return machine([0], [0], inputs, step)


def clause_machines() -> list[Transducer]:
    machines = [target_machine()]
    for build in (negation_machine, report_machine, insult_machine, threat_machine):
        machines.append(build(outputs(machines[-1])))
    return machines


CLAUSE_MACHINE = cascade(clause_machines())


@dataclass
class Grammar:
    """The lexicon and the clause machine. ``arcs``: the weight of each insult, a word or the
    first letters of longer words and a star."""

    arcs: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.classes: dict[str, int] = {}
        for bit, words in ((TARGET, TARGETS), (NEGATOR, NEGATORS), (REPORTER, REPORTERS), (THREAT, THREATS)):
            for word in words.split():
                self.classes[word] = self.classes.get(word, 0) | bit
        self.whole = frozenset(THREATS.split()).union(self.arcs)
        self.plain: set[str] = set()
        self.stems = {n: frozenset(arc[:n] for arc in self.arcs if arc.endswith("*") and len(arc) == n + 1) for n in STEMS}

    def insult(self, word: str) -> float:
        """The weight of the heaviest arc that accepts ``word``."""
        weight = self.arcs.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                weight = max(weight, self.arcs.get(word[:n] + "*", 0.0))
        return weight

    def matching(self, words: set[str]) -> set[str]:
        """Those of ``words`` that are insults or threats; most texts have none."""
        words = words - self.plain
        if self.whole.isdisjoint(words) and all(self.stems[n].isdisjoint([w[:n] for w in words]) for n in STEMS):
            found = set()
        else:
            found = {w for w in words if self.read(w)[0] & (INSULT | THREAT)}
        if len(self.plain) > PLAIN_WORDS:
            self.plain.clear()
        self.plain.update(w for w in words if len(w) <= PLAIN_LENGTH and w not in found)
        return found

    def read(self, word: str) -> tuple[int, float]:
        """The symbol of a word and its weight."""
        classes, weight = self.classes.get(word, 0), self.insult(word)
        return (classes | INSULT, weight) if weight > 0 else (classes, THREAT_WEIGHT if classes & THREAT else 0.0)

    def path(self, clause: list[str], matching: set[str]) -> tuple[float, list[tuple[str, str, float]]]:
        """The weight of the clause's path and the (word, kind, weight) of each match. A verb
        threatens once in a clause, however often it is read."""
        if matching.isdisjoint(clause):
            return 0.0, []
        _, written = best_path(CLAUSE_MACHINE, *zip(*map(self.read, clause)))
        found, made = [], set()
        for place, out, weight in written:
            word, kind = clause[place], KINDS[out - 1]
            if kind != "threat" or word not in made:
                found.append((word, kind, weight))
            if kind == "threat":
                made.add(word)
        return sum(weight for _, _, weight in found), found

    def matches(self, clause: list[str]) -> list[tuple[str, str, float]]:
        return self.path(clause, self.matching(set(clause)))[1]

    def features(self, text: str | None) -> np.ndarray:
        """The shared features, then those of each kind."""
        row = np.zeros(WIDTH)
        lowered = (text or "").lower()
        matching = self.matching(set(WORD.findall(lowered)))
        if not matching:
            return row
        forms = set()
        for clause in CLAUSE.split(lowered):
            # a clause that holds a match holds its letters
            if not any(word in clause for word in matching):
                continue
            weight, found = self.path(WORD.findall(clause), matching)
            row[2] += weight
            row[3] = max(row[3], weight)
            row[4] += any(kind not in ("negated", "reported") for _, kind, _ in found)
            for word, kind, part in found:
                if kind not in ("negated", "reported"):
                    forms.add(word)
                    row[1] += 1
                if kind in PRIORS:
                    at = SHARED + 2 * list(PRIORS).index(kind)
                    row[at] += part
                    row[at + 1] += 1
        row[0] = len(forms)
        row = np.log1p(row)
        row[5] = float(len(forms) > 1)
        return row


@dataclass
class ToxicityModel:
    grammar: Grammar
    weights: np.ndarray | None = None

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.grammar.features(text) @ self.weights[:-1] + self.weights[-1], -50, 50))))


def forms_of(text: Column) -> Column:
    """The distinct words of a text, and stems (marked by a star) of the longer ones."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))

    def stems(n: int) -> Column:
        longer = F.filter(words, lambda w: F.length(w) > n)
        return F.transform(longer, lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return F.filter(F.array_distinct(F.concat(words, *map(stems, STEMS))), lambda w: w != "")


def _evidence(t: float, n: float, base: float) -> tuple[float, float]:
    """Likelihood ratio and log odds of a form that ``t`` toxic rows of ``n`` hold."""
    if t < 2 or t / n <= base:
        return 0.0, 0.0
    ratio = 2 * (t * np.log(t / n / base) + ((n - t) * np.log((1 - t / n) / (1 - base)) if n > t else 0.0))
    return ratio, np.log((t + 0.5) / (n - t + 0.5)) - np.log(base / (1 - base))


def _beyond_chance(t: Column, n: Column, base: float, bound: float) -> Column:
    """Whether the likelihood ratio of :func:`_evidence` is above ``bound``, give or take rounding."""
    clean, rows = n - t, F.greatest(n, F.lit(1.0))
    ratio = 2 * (t * F.ln(t / rows / base) + F.when(clean > 0, clean * F.ln(clean / rows / (1 - base))).otherwise(0.0))
    return F.when((t >= 2) & (t / rows > base), ratio > bound - 1e-6).otherwise(False)


def learn_arcs(rows: DataFrame) -> list[dict[str, float]]:
    """Forms that toxic rows hold beyond chance, with their log odds: learned without each of the
    ``FOLDS`` folds in turn, and last from all. ``rows``: ``fold, text, toxic``; each is counted."""
    distinct = rows.groupBy(F.xxhash64("text").alias("print"), "toxic").agg(F.first("text").alias("text"), F.first("fold").alias("fold"))
    totals = np.zeros((FOLDS, 2))
    for r in distinct.groupBy("fold", "toxic").count().collect():
        totals[r.fold, r.toxic] = r["count"]
    if not totals.sum(axis=0).all():
        return [{}] * (FOLDS + 1)
    folded = lambda value, f: F.sum(F.when(F.col("fold") == f, value).otherwise(0)).cast("double")
    counted = (
        distinct.select("fold", "toxic", F.explode(forms_of(F.col("text"))).alias("form"))
        .groupBy("form")
        .agg(
            F.sum("toxic").cast("double").alias("t"),
            F.count("*").cast("double").alias("n"),
            *[folded(F.col("toxic"), f).alias(f"t{f}") for f in range(FOLDS)],
            *[folded(F.lit(1), f).alias(f"n{f}") for f in range(FOLDS)],
        )
    )
    # Every form that passes the bound on all rows or without one of the folds.
    split, passes = [], F.lit(False)
    for out in range(FOLDS + 1):
        left = totals.sum(axis=0) - (totals[out] if out < FOLDS else 0)
        base, bound = float(left[1] / max(1, left.sum())), float(2 * np.log(max(1, left.sum())) + 10)
        split.append((left.all(), base, bound))
        if left.all():
            t, n = (F.col("t") - F.col(f"t{out}"), F.col("n") - F.col(f"n{out}")) if out < FOLDS else (F.col("t"), F.col("n"))
            passes = passes | _beyond_chance(t, n, base, bound)
    kept = counted.filter(passes).collect()
    learned = []
    for out, (both, base, bound) in enumerate(split):
        arcs = {}
        if both:
            for r in kept:
                t, n = (r.t - r[f"t{out}"], r.n - r[f"n{out}"]) if out < FOLDS else (r.t, r.n)
                ratio, odds = _evidence(t, n, base)
                if ratio > bound:
                    arcs[r.form] = float(odds)
        learned.append(arcs)
    return learned


def fit_sample(rows: DataFrame, share: float) -> DataFrame:
    """``fold, text, toxic, weight``: one row for each drawn text and label. A text is drawn with a
    probability of ``share`` for each of its rows, and surely with ``1 / share`` of them; those it has
    beyond that are its weight. ``rows``: ``fold, place, text, toxic``."""
    held = F.col("copies") * F.lit(share)
    marked = rows.withColumn("print", F.xxhash64("text"))
    # one number for each text first; of the texts, only drawn ones are shuffled
    drawn = (
        marked.groupBy("print", "toxic")
        .agg(F.first("place").alias("at"), F.count("*").alias("copies"))
        .filter(F.floor(F.col("at") / FOLDS) < F.least(held, F.lit(1.0)) * F.lit(1 << 20))
        .select("print", "toxic", F.greatest(held, F.lit(1.0)).alias("weight"))
    )
    return (
        marked.join(F.broadcast(drawn), ["print", "toxic"])
        .groupBy("print", "toxic")
        .agg(*[F.first(c).alias(c) for c in ("fold", "text", "weight")])
        .select("fold", "text", "toxic", "weight")
    )


def prior_weights() -> np.ndarray:
    """The regression's weights before any data; the last is the bias."""
    prior = np.zeros(WIDTH + 1)
    prior[SHARED:WIDTH:2] = list(PRIORS.values())
    return prior


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Logistic regression of rows that count ``n`` times, drawn to its priors, by Newton steps; the
    last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    prior = prior_weights()
    w = prior.copy()
    penalty = np.full(len(w), ridge)
    penalty[SHARED:] = 1.0
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(hessian, x.T @ (n * (p - y)) + penalty * (w - prior))
    return w


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """``labels``: ``doc_id`` and ``toxic`` (0 or 1) of training rows; nulls are left out, and a
    ``doc_id`` labelled twice is toxic if one label says so."""
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    small = known.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").alias("__id"), text_of().alias("text"))
    rows = texts.join(F.broadcast(known) if small else known, "__id")
    place = F.pmod(F.xxhash64("text", F.lit("toxicity")), F.lit(FOLDS << 20))
    rows = rows.withColumn("place", place).withColumn("fold", (F.col("place") % FOLDS).cast("int"))
    *without, arcs = learn_arcs(rows.select("fold", "text", "toxic"))
    grammars = [Grammar(a) for a in without]
    share = min(1.0, SAMPLE_DOCS / max(1, known.count()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [grammars[f].features(t).tolist() for f, t in zip(batch["fold"].to_pylist(), batch["text"].to_pylist())]
            yield pa.record_batch({"x": pa.array(found, pa.list_(pa.float64())), "toxic": batch["toxic"].cast(pa.int32()), "weight": batch["weight"]})

    sampled = fit_sample(rows.select("fold", "place", "text", "toxic"), share)
    got = sorted((tuple(r.x), r.toxic, r.weight) for r in sampled.mapInArrow(measure, "x array<double>, toxic int, weight double").collect())
    if len({y for _, y, _ in got}) < 2:
        return ToxicityModel(Grammar(arcs))
    x, y, n = (np.array(column, float) for column in zip(*got))
    return ToxicityModel(Grammar(arcs), _fit(x, y, n))


def score(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``docs`` with ``column``: the probability, from the text alone, that a label says toxic."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) for t in batch["text"].cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], schema=_with(batch.schema, column))

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(column, DoubleType())
    return docs.mapInArrow(scores, schema)


def _with(schema: pa.Schema, column: str) -> pa.Schema:
    return schema.append(pa.field(column, pa.float64()))
