"""Toxicity: a weighted finite-state pattern grammar over clauses.

Records are texts keyed by ``source_id`` (notes and captions beside images); the project has no text table, so the operator
stays general.  Labels are only used to learn the lexicon's weights and the calibration.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import labelled_sample

# Seed words of the grammar's classes in English, German, French and Spanish.
INSULTS = (
    "idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "filth",
    "vermin", "dumb", "dumm", "dummkopf", "trottel", "abschaum", "arschloch", "imbécile", "débile", "connard",
    "ordure", "estúpido", "imbécil", "basura", "escoria",
)
THREATS = ("kill", "hurt", "destroy", "murder", "beat", "töten", "umbringen", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "he", "she", "they", "them", "him", "her", "du", "dich", "ihr", "tu", "toi", "vous", "te", "usted", "ellos")
NEGATIONS = ("not", "never", "no", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás", "ningún")
REPORTS = ("said", "says", "wrote", "claims", "quoted", "sagte", "schrieb", "dit", "disait", "dijo", "escribió")

WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
ENDS = ".!?;:\n"  # the same characters


@dataclass(frozen=True)
class Transducer:
    """A small machine: ``arcs[(state, class)] = (next state, output weight)``; other classes fall back to ``rest``.

    ``rest[state] = next state`` on every class without an arc, with output 1.  Outputs multiply along a composition.
    """

    arcs: dict[tuple[int, str], tuple[int, float]]
    rest: dict[int, int]

    def step(self, state: int, kind: str) -> tuple[int, float]:
        return self.arcs.get((state, kind), (self.rest[state], 1.0))


def memory(trigger: str, reach: int, factors: dict[str, float]) -> Transducer:
    """After ``trigger``, the next ``reach`` words remember it: classes in ``factors`` are then scaled."""
    arcs: dict[tuple[int, str], tuple[int, float]] = {}
    for state in range(reach + 1):
        arcs[(state, trigger)] = (reach, 1.0)
        for kind, factor in factors.items():
            if state and kind != trigger:
                arcs[(state, kind)] = (state - 1, factor)
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


def threat() -> Transducer:
    """A threat word counts only once a target follows within four words; until then its own weight is withheld."""
    arcs: dict[tuple[int, str], tuple[int, float]] = {}
    for state in range(5):
        arcs[(state, "threat")] = (4, 0.0)
        if state:
            arcs[(state, "target")] = (0, 2.0)
        else:
            arcs[(state, "target")] = (0, 0.0)
    return Transducer(arcs, {s: max(0, s - 1) for s in range(5)})


@dataclass
class Composition:
    """Product of transducers, built as states are reached: one table lookup per word while a clause is read."""

    parts: tuple[Transducer, ...]
    table: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], float]] = field(default_factory=dict)

    def step(self, state: tuple[int, ...], kind: str) -> tuple[tuple[int, ...], float]:
        found = self.table.get((state, kind))
        if found is None:
            moves = [p.step(s, kind) for p, s in zip(self.parts, state)]
            weight = 1.0
            for _, w in moves:
                weight *= w
            found = self.table[(state, kind)] = (tuple(s for s, _ in moves), weight)
        return found

    def clause(self, words: Iterable[tuple[str, float]]) -> float:
        """Weight of one clause given (class, lexicon weight) per word."""
        state, total = (0,) * len(self.parts), 0.0
        for kind, weight in words:
            state, factor = self.step(state, kind)
            total += weight * factor
        return total


def grammar() -> Composition:
    """insult x target x negation x reported speech x threat."""
    return Composition((
        memory("target", 4, {"insult": 1.5}),
        memory("negation", 3, {"insult": 0.4, "target": 0.4}),
        memory("report", 6, {"insult": 0.6, "target": 0.6}),
        threat(),
    ))


@dataclass(frozen=True)
class ToxicityModel:
    """``words`` and ``stems`` map an entry to its insult weight; ``slope`` and ``offset`` turn a text's sum into a score."""

    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 2.0
    offset: float = -2.0


class Matcher:
    """Lexicon transducer: one automaton over all entries finds places, the grammar reads the clauses around them."""

    def __init__(self, model: ToxicityModel):
        import ahocorasick

        self.model, self.grammar = model, grammar()
        self.closed = {w: k for k, ws in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}
        self.automaton = ahocorasick.Automaton()
        for entry in {*model.words, *model.stems, *THREATS}:
            self.automaton.add_word(entry, len(entry))
        self.automaton.make_automaton()

    def classify(self, word: str) -> tuple[str, float]:
        kind = self.closed.get(word)
        weight = self.model.words.get(word)
        if weight is None and kind is None:
            weight = max((self.model.stems[word[:k]] for k in STEM_LENGTHS if word[:k] in self.model.stems), default=None)
        if weight is not None:
            return "insult", weight
        # a target's own weight is only paid by the threat machine
        return (kind, 1.0 if kind in ("threat", "target") else 0.0) if kind else ("other", 0.0)

    def total(self, text: str) -> float:
        """Sum of the weights of all clauses that hold a match; each is read once, as a whole, word by word."""
        low, total, done = text.lower(), 0.0, 0
        for end, size in self.automaton.iter(low):
            start = end - size + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            begin = max(done, *(low.rfind(c, done, start) + 1 for c in ENDS))
            stop = CLAUSE_END.search(low, end)
            done = stop.start() if stop else len(low)
            total += self.grammar.clause(self.classify(m.group()) for m in WORD.finditer(low, begin, done))
        return total


def word_forms(text: str) -> set[str]:
    """Distinct words and word beginnings of a text; a trailing ``*`` marks a beginning."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}


def copy_key(text: str) -> int:
    """Smallest hash of the text's three-word shingles: copies with small changes mostly share it."""
    import zlib

    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))), default=0)


def fit_toxicity(records: DataFrame, labels: DataFrame, rows_per_label: int = 6000) -> ToxicityModel:
    """Action: learns lexicon weights from (source_id, text) and (source_id, toxic), on about ``rows_per_label`` of each label.

    Counts of words and word beginnings by label are summed on Spark over one text of each group of copies; entries that
    are significantly tied to the label become insults of the lexicon, all of them: the rows bound their number.  The calibration is fitted on the sample's clause sums.  Null labels are not used, null text is empty.
    Without labels the seed words and a fixed calibration remain.
    """
    usable = labels.select("source_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    sample = labelled_sample(records, usable, "toxic", rows_per_label)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(key=[copy_key(t) for t in batch["text"]])

    single = (
        sample.select("text", "toxic").mapInPandas(keys, "text string, toxic int, key long")
        .groupBy("key", "toxic").agg(F.min("text").alias("text"))
    )

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}
        rows = [0, 0]
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"]):
                rows[label] += 1
                for form in word_forms(text):
                    counts.setdefault(form, [0, 0])[label] += 1
        if sum(rows):
            yield pd.DataFrame({"form": [None, *counts], "clean": [rows[0], *(c[0] for c in counts.values())], "toxic": [rows[1], *(c[1] for c in counts.values())]})

    counted = single.select("text", "toxic").mapInPandas(forms, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seeds = {w: 3.0 for w in INSULTS}
    head = counted.where(F.col("form").isNull()).collect()
    if not head or not head[0]["toxic"] or not head[0]["clean"]:
        return ToxicityModel(seeds, {})
    n_clean, n_toxic = head[0]["clean"], head[0]["toxic"]
    # log-likelihood ratio of "the form follows the label" against "it does not", where the form is rare in clean texts
    smooth = (F.log((F.col("toxic") + 0.5) / (n_toxic - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (n_clean - F.col("clean") + 0.5)))
    share = F.lit(n_toxic / (n_toxic + n_clean))
    seen = F.col("toxic") + F.col("clean")
    gain = 2 * (
        F.when(F.col("toxic") > 0, F.col("toxic") * F.log(F.col("toxic") / seen / share)).otherwise(0.0)
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / seen / (1 - share))).otherwise(0.0)
    )
    cut = 2 * float(np.log(max(2, n_clean + n_toxic) * 50.0)) + 4
    best = (
        counted.where(F.col("form").isNotNull()).withColumn("weight", smooth).withColumn("gain", gain)
        .where((F.col("weight") > 3) & (F.col("gain") > cut)).orderBy(F.desc("gain"), F.desc(F.length("form")), "form")
        .select("form", "weight").collect()
    )
    words, stems, begun = dict(seeds), {}, set()
    for form, weight in best:
        stem = form.rstrip("*")
        # a stronger entry that is a beginning of this one, or that this one is a beginning of, already speaks for it
        if stem in begun or any(stem[:k] in stems for k in STEM_LENGTHS):
            continue
        (stems if form.endswith("*") else words)[stem] = float(weight)
        begun.update(stem[:k] for k in range(1, len(stem) + 1))
    model = ToxicityModel(words, stems)
    shared = records.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for batch in batches:
            yield pd.DataFrame({"total": [matcher.total(t) for t in batch["text"]], "toxic": batch["toxic"]})

    points = sample.select("text", "toxic").mapInPandas(sums, "total double, toxic int").toPandas()
    marks = points["toxic"].to_numpy(dtype=float)
    # the sample takes each label up to its bound: weights bring back the labels' shares among all labelled rows
    rows = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    weight = np.where(marks > 0, rows[1] / max(1, (marks > 0).sum()), rows[0] / max(1, (marks == 0).sum()))
    slope, offset = calibrate(np.log1p(np.maximum(points["total"].to_numpy(), 0.0)), marks, weight)
    return ToxicityModel(words, stems, slope, offset)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic slope (not negative) and offset by Newton steps, slightly penalised, of weighted points."""
    order = np.lexsort((y, x))
    x, y, weight = x[order], y[order], weight[order] / weight.sum()
    beta = np.array([1.0, -1.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-5 * beta
        hess = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + 1e-5 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (2.0, -2.0)


def score_toxicity(records: DataFrame, model: ToxicityModel) -> DataFrame:
    """(source_id, text) to (source_id, clause_weight, score), one row per record.

    Method: insult entries, threats, targets, negation and reported speech are weighted transducers; their composition reads
    the clauses in which the lexicon automaton finds an entry, so a word counts by its clause: more near a target, less when
    negated or reported, a threat only with a target.  The lexicon, bounded by the rows it was learnt from, is broadcast; one pass, no shuffle.

    Null and empty texts have weight 0 and the lowest score.  Null ids and repeated rows are scored like others; other
    columns are ignored.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([
        T.StructField("source_id", records.schema["source_id"].dataType), T.StructField("clause_weight", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        matcher = Matcher(model)
        for batch in batches:
            totals = np.array([matcher.total(t) if isinstance(t, str) else 0.0 for t in batch["text"]], dtype=float)
            logit = model.offset + model.slope * np.log1p(np.maximum(totals, 0.0))
            yield pd.DataFrame({"source_id": batch["source_id"], "clause_weight": totals, "score": 1.0 / (1.0 + np.exp(-logit))})

    return records.select("source_id", "text").mapInPandas(score, schema)
