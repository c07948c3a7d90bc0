"""Toxicity scores from a weighted finite-state pattern grammar.

A lexicon rewrites the words of a clause to symbols: insults by learned stems, threats, targets,
negations and verbs of reported speech by short lists. Three transducers read the symbols one
after another: the first takes the insults and threats within a negation's reach out, the second
those within the reach of reported speech, the third finds the targets of the rest on either
side. They are composed into one machine, whose arcs carry events:

    insult     an insult that the clause asserts: it is neither negated nor reported
    targeted   such an insult with a target near it
    threat     a threat with a target near it, neither negated nor reported
    negated    an insult or threat that a negation takes back
    reported   an insult or threat that somebody else said

A text's evidence is what the paths of its clauses sum up to, event by event. The weights of the
events are learned with their signs fixed: the first three add, the last two subtract. A threat
without a target, and a word that is in no clause with an event, count for nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm import runtime as R

#: Labelled rows of each class that the fit sees at most, and lengths of stems.
FIT_ROWS, STEMS = 5000, (4, 5, 6, 7, 8)
LEAST_COUNT, LEAST_SHARE = 6, 0.95
#: Symbols that a negation reaches over, that reported speech does, and between an insult and its target.
NEGATION_REACH, REPORT_REACH, TARGET_REACH = 3, 12, 6

# Words of the closed classes in English, French, German and Spanish.
TARGETS = frozenset("you your yours yourself u ur he she they them him her toi vous ton votre tes vos du dich dir dein euch ihr tú usted ustedes te ti vosotros".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't neither nor pas jamais aucun nicht kein keine niemals nunca jamás tampoco".split())
REPORTS = frozenset("said says say wrote writes claimed quoted called according reported dit disait écrit sagte sagt schrieb laut dijo dice escribió según".split())
THREATS = frozenset("kill killing murder hurt destroy punch shoot stab tuer frapper mourir töten umbringen sterben schlagen matar morir golpear".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_END = re.compile(r"[.!?;\n]")

SYMBOLS = ("-", "neg", "rep", "tgt", "insult", "threat")
EVENTS = ("insult", "targeted", "threat", "negated", "reported")
#: Signs of the events' weights, and what these are where no label says otherwise.
SIGNS, PRIOR = (1, 1, 1, -1, -1), (2.0, 0.5, 2.0, -0.5, -0.5)
#: For each event the log of one plus its sum, and whether it occurs.
NUMBERS = 2 * len(EVENTS)

Arc = tuple[int, str, tuple[str, ...]]


@dataclass
class Transducer:
    """A deterministic transducer: arcs[state][symbol] is the next state, the symbol written, and events."""

    arcs: list[dict[str, Arc]]

    def run(self, symbols: list[str]) -> tuple[list[str], list[tuple[str, ...]]]:
        state, written, events = 0, [], []
        for s in symbols:
            state, out, e = self.arcs[state][s]
            written.append(out)
            events.append(e)
        return written, events


def _built(start, step, symbols: tuple[str, ...]) -> Transducer:
    """The machine of all states that ``step`` reaches from ``start``, numbered as they are met."""
    number, todo, arcs = {start: 0}, [start], []
    for state in todo:
        row = {}
        for s in symbols:
            to, out, events = step(state, s)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[s] = (number[to], out, events)
        arcs.append(row)
    return Transducer(arcs)


def scope(trigger: str, reach: int, event: str) -> Transducer:
    """Insults and threats within ``reach`` symbols after ``trigger`` are taken out, with an event."""

    def step(left: int, s: str):
        if s == trigger:
            return reach, s, ()
        if left and s in ("insult", "threat"):
            return left - 1, "-", (event,)
        return max(left - 1, 0), s, ()

    return _built(0, step, SYMBOLS)


def targets(reach: int) -> Transducer:
    """Insults, and those and threats with a target at most ``reach`` symbols before or after."""

    def step(state: tuple[int, int, int], s: str):
        near, insult, threat = state  # how far a target, an insult and a threat without one still reach
        down = tuple(max(x - 1, 0) for x in state)
        if s == "tgt":
            return (reach, 0, 0), s, ("targeted",) * (insult > 0) + ("threat",) * (threat > 0)
        if s == "insult":
            return (down[0], 0 if near else reach, down[2]), s, ("insult", "targeted") if near else ("insult",)
        if s == "threat":
            return (down[0], down[1], 0 if near else reach), s, ("threat",) if near else ()
        return down, s, ()

    return _built((0, 0, 0), step, SYMBOLS)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that does what ``b`` does with what ``a`` writes, with the events of both."""

    def step(state: tuple[int, int], s: str):
        x, middle, first = a.arcs[state[0]][s]
        y, out, second = b.arcs[state[1]][middle]
        return (x, y), out, first + second

    return _built((0, 0), step, SYMBOLS)


@cache
def machine() -> Transducer:
    negated, reported = scope("neg", NEGATION_REACH, "negated"), scope("rep", REPORT_REACH, "reported")
    return compose(compose(negated, reported), targets(TARGET_REACH))


def symbols_of(words: list[str], patterns: dict[str, float]) -> tuple[list[str], list[float]]:
    """The lexicon: a symbol and a weight for each word; the longest stem that is a pattern counts."""
    symbols, weights = [], []
    for w in words:
        weight = next((patterns[w[:n]] for n in reversed(STEMS) if len(w) >= n and w[:n] in patterns), None)
        if weight is not None:
            symbols.append("insult")
        elif w in THREATS:
            symbols.append("threat")
        else:
            symbols.append("tgt" if w in TARGETS else "neg" if w in NEGATIONS else "rep" if w in REPORTS else "-")
        weights.append(weight or 1.0)
    return symbols, weights


def clause_events(words: list[str], patterns: dict[str, float]) -> list[tuple[str, float]]:
    """Events of a clause with their weights: those of insults have their stem's, others one."""
    symbols, weights = symbols_of(words, patterns)
    _, events = machine().run(symbols)
    return [(e, w if e in ("insult", "negated", "reported") else 1.0) for es, w in zip(events, weights, strict=True) for e in es]


class Grammar:
    """The patterns, and the search for clauses that may match."""

    def __init__(self, patterns: dict[str, float]) -> None:
        self.patterns = patterns
        self.automaton = ahocorasick.Automaton()
        for p in {*patterns, *THREATS}:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()

    def evidence(self, text: str | None) -> np.ndarray:
        """For each event the log of one plus the sum of its weights, and whether it occurs."""
        out = np.zeros(NUMBERS)
        if not text:
            return out
        low = text.lower()
        sums: Counter[str] = Counter()
        done = -1
        for last, size in self.automaton.iter(low):
            start = last - size + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            a = max(low.rfind(c, max(done, 0), start) for c in ".!?;\n") + 1
            a = max(a, done, 0)
            end = _END.search(low, last + 1)
            done = end.start() if end else len(low)
            for event, weight in clause_events(WORD.findall(low, a, done), self.patterns):
                sums[event] += weight
        for i, event in enumerate(EVENTS):
            out[2 * i], out[2 * i + 1] = np.log1p(sums[event]), event in sums
        return out


def _features(text: str | None) -> set[str]:
    return {w[:n] for w in set(WORD.findall((text or "").lower())) for n in STEMS if len(w) >= n}


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(_features(text))
        keys = list(counts[1])  # stems that no toxic text has are no candidates
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["stem", "toxic", "clean"])


def _clean_counts(stems: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if not toxic:
                    counts.update(_features(text) & stems)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["stem", "clean"])

    return run


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Stems with weights, their log odds: common and nearly exclusive to toxic texts.

    Of a stem and a longer one that covers nearly as many texts the longer is taken.
    """
    good = {s: (a, b) for s, a, b in counts if a >= LEAST_COUNT and a / max(toxic, 1) >= LEAST_SHARE * (a / max(toxic, 1) + b / max(clean, 1))}
    longer: dict[str, int] = {}
    for s, (a, _) in good.items():
        for n in STEMS:
            if n < len(s):
                longer[s[:n]] = max(longer.get(s[:n], 0), a)
    out: dict[str, float] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):
        a, b = good[s]
        if longer.get(s, 0) < 0.95 * a and not any(s[:n] in out for n in STEMS if n < len(s)):
            out[s] = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
    return out


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Weights, a constant last, of a logistic regression with a ridge around PRIOR and the SIGNS kept.

    One coordinate after another takes a Newton step and is moved back to its side of zero.
    """
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    prior = np.append(np.repeat(PRIOR, 2), 0.0)
    signs = np.append(np.repeat(SIGNS, 2), 0)
    penalty = np.append(np.full(NUMBERS, ridge), 1e-3)
    w = prior.copy()
    z = x @ w
    for _ in range(rounds):
        most = 0.0
        for k in range(x.shape[1]):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            slope = x[:, k] @ (weight * (p - y)) + penalty[k] * (w[k] - prior[k])
            new = w[k] - np.clip(slope / ((x[:, k] ** 2) @ (weight * np.maximum(p * (1 - p), 1e-6)) + penalty[k]), -1, 1)
            if signs[k] * new < 0:
                new = 0.0
            z += x[:, k] * (new - w[k])
            most = max(most, abs(new - w[k]))
            w[k] = new
        if most < 1e-7:
            break
    return w


@dataclass
class Model:
    patterns: dict[str, float]
    weights: np.ndarray


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit patterns and weights to documents (doc_id, text) with labels (doc_id, toxic).

    The fit sees FIT_ROWS labelled documents of each class at most, those with the smallest
    hashes of their ids. Null ids and labels are left out; a document with several labels is
    toxic if one of them says so. Without documents of both classes there are no patterns, and
    the weights are PRIOR's, with the classes' shares as the constant.
    """
    documents, labels = R.columns(documents, "doc_id", "text"), R.columns(labels, "doc_id", "toxic")
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    sizes = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    position = F.xxhash64("doc_id").cast("double") / float(1 << 64) + 0.5
    share = F.when(F.col("toxic") == 1, min(1.0, FIT_ROWS / max(1, sizes.get(1, 0)))).otherwise(min(1.0, FIT_ROWS / max(1, sizes.get(0, 0))))
    sample = labelled.where(position <= share)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    rows = R.stored(rows.repartition(R.partitions(documents.sparkSession)), "labelled")
    seen = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = seen.get(1, 0), seen.get(0, 0)
    all_toxic, all_clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log((all_toxic + 0.5) / (all_clean + 0.5)))
    if not toxic or not clean:
        return Model({}, np.append(np.repeat(PRIOR, 2), prior))
    # clean counts of a batch without a toxic text are not in the first counts, so those of candidates are counted apart
    often = R.arrow_map(rows, _feature_counts, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    bound = (1 - LEAST_SHARE) / LEAST_SHARE * clean / toxic
    often = often.where((F.col("toxic") >= LEAST_COUNT) & (F.col("clean") <= F.col("toxic") * bound + 1)).collect()
    stems = frozenset(r.stem for r in often)
    clean_of = {r.stem: r.clean for r in R.arrow_map(rows, _clean_counts(stems), "stem string, clean long").groupBy("stem").agg(F.sum("clean").alias("clean")).collect()}
    patterns = choose([(r.stem, r.toxic, clean_of.get(r.stem, 0)) for r in often], toxic, clean)
    got = R.arrow_map(rows, _evidence(patterns), "toxic int, x binary").collect()
    got.sort(key=lambda r: (r.toxic, r.x))
    x, y = np.asarray([np.frombuffer(r.x) for r in got]), np.asarray([r.toxic for r in got])
    weight = np.where(y == 1, all_toxic / toxic, all_clean / clean)
    return Model(patterns, fitted(x, y, weight))


def _evidence(patterns: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(patterns)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array([grammar.evidence(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["toxic", "x"])

    return run


def score(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with score, the probability that its text is toxic.

    Null and empty texts have no evidence, and the score of such. Repeated rows and nulls in
    other columns are kept as they are; an empty table gives no rows. A clause of any length is
    read whole.
    """
    rows = R.columns(documents, *keep, "text").select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.patterns)
        for batch in batches:
            x = np.asarray([grammar.evidence(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, NUMBERS)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return R.arrow_map(rows, run, f"{schema}, score double")
