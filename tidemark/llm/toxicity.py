"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, slight, threat, target, negation, report). Five sequential transducers read the classes of a
clause one after the other: reported speech marks what it covers, then negation, then a target nearby, and at last threats
and insults become events by these marks. They are composed into a single transducer whose arcs carry weights, so a
clause has the weight of its path. A document is scored by its heaviest clause (words outside the grammar have none), and
the weights of the arcs are learned from labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, is_training, one_label, releasing, taught

#: Words of each class, in English, German, French and Spanish.
INSULTS = "asshole bastard clown creep disgusting dumb idiot idiots imbecile jerk loser losers moron morons pathetic scum stupid trash vermin worthless abschaum arschloch dummkopf trottel widerlich wertlos connard crétin imbécile minable salaud estúpido estúpida gilipollas idiota idiotas imbécil patético patética escoria".split()
SLIGHTS = "annoying awful coward fool garbage lazy liar ugly useless feige hässlich lügner nutzlos lâche menteur nul cobarde feo inútil mentiroso".split()
THREATS = "beat burn crush destroy hurt kill murder punish shoot stab strangle töten umbringen verprügeln tuer frapper matar golpear".split()
TARGETS = "you your you're yourself u he she they him her them his their everyone people du dich dir ihr euch sie er tu toi te vous il elle ils elles lui leur tú ti te usted ustedes él ella ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't can't nobody nicht kein keine nie niemals ne pas jamais nunca jamás tampoco".split()
REPORTS = "said says say called calls wrote writes claimed claims quoted reported according sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()

OTHER, INSULT, SLIGHT, THREAT, TARGET, NEGATION, REPORT = range(7)
EVENTS = ("insult", "insult_target", "insult_negated", "insult_reported", "slight", "slight_target", "threat", "threat_target", "threat_negated", "threat_reported")
#: Weights of the events before any label is seen.
PRIOR = np.array([1.6, 2.6, 0.7, 0.9, 0.3, 0.8, 0.3, 1.8, 0.1, 0.5])
BIAS = -3.0
WINDOW = 4
#: Labelled rows, and bytes of their texts, that are learned from at most; documents that must have a word to teach it.
MAX_LABELLED, MAX_BYTES, LEAST_DOCUMENTS = 20_000, 256 << 20, 15
_CLAUSES = re.compile(r"[.!?;:\n]+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


class Transducer:
    """A sequential weighted transducer: (state, label) -> (state, output, weight); labels without an arc pass as they are."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, label):
        return self.arcs.get((state, label)) or (state, label, 0.0)

    def compose(self, other: Transducer, labels: list) -> Transducer:
        """The transducer that feeds its outputs to the other; weights add up. labels: the inputs to build arcs for."""
        start, arcs = (self.start, other.start), {}
        todo, seen = [start], {start}
        while todo:
            a, b = state = todo.pop()
            for label in labels:
                to_a, mid, w = self.step(a, label)
                to_b, out, v = other.step(b, mid)
                arcs[state, label] = ((to_a, to_b), out, w + v)
                if (to_a, to_b) not in seen:
                    seen.add((to_a, to_b))
                    todo.append((to_a, to_b))
        return Transducer(start, arcs)

    def run(self, labels: list) -> tuple[list, float]:
        state, out, weight = self.start, [], 0.0
        for label in labels:
            state, o, w = self.step(state, label)
            out.append(o)
            weight += w
        return out, weight


def reports() -> Transducer:
    """class -> (class, cover): "reported" after a word of reporting."""
    arcs = {}
    for on in (False, True):
        for label in range(7):
            arcs[on, label] = (on or label == REPORT, (label, "reported" if on else ""), 0.0)
    return Transducer(False, arcs)


def negations() -> Transducer:
    """(class, cover) -> (class, cover): "negated" for WINDOW words after a negation."""
    arcs = {}
    for left in range(WINDOW + 1):
        for label in range(7):
            for cover in ("", "reported"):
                arcs[left, (label, cover)] = (WINDOW if label == NEGATION else max(0, left - 1), (label, "negated" if left else cover), 0.0)
    return Transducer(0, arcs)


def targets() -> Transducer:
    """(class, cover) -> (class, cover): "target" for WINDOW words after a target, where nothing else covers a word."""
    arcs = {}
    for left in range(WINDOW + 1):
        for label in range(7):
            for cover in ("", "reported", "negated"):
                arcs[left, (label, cover)] = (WINDOW if label == TARGET else max(0, left - 1), (label, cover or ("target" if left else "")), 0.0)
    return Transducer(0, arcs)


_COVERS = ("", "reported", "negated", "target")


def threats(weights: np.ndarray) -> Transducer:
    """(class, cover) -> an event of a threat, with its weight; other labels pass."""
    arcs = {}
    for cover in _COVERS:
        event = f"threat_{cover}" if cover else "threat"
        arcs[0, (THREAT, cover)] = (0, event, float(weights[EVENTS.index(event)]))
    return Transducer(0, arcs)


def insults(weights: np.ndarray) -> Transducer:
    """(class, cover) -> an event of an insult or a slight, with its weight; events pass, and all else becomes nothing."""
    arcs = {}
    for cover in _COVERS:
        for label in range(7):
            name = "insult" if label == INSULT else "slight" if label == SLIGHT and cover in ("", "target") else None
            event = (f"{name}_{cover}" if cover else name) if name else None
            arcs[0, (label, cover)] = (0, event, float(weights[EVENTS.index(event)]) if event else 0.0)
    return Transducer(0, arcs)


def grammar_machines(weights: np.ndarray) -> list[Transducer]:
    return [reports(), negations(), targets(), threats(weights), insults(weights)]


def composed(machines: list[Transducer]) -> Transducer:
    out = machines[0]
    for m in machines[1:]:
        out = out.compose(m, list(range(7)))
    return out


class Grammar:
    """The composed transducer with weights of its events, and the words of each class (learned ones are insults)."""

    def __init__(self, learned: list[str] = (), weights: np.ndarray = PRIOR):  # type: ignore[assignment]
        self.classes = {w: c for c, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (SLIGHT, SLIGHTS), (INSULT, [*INSULTS, *learned])) for w in words}
        heads = sorted((w for w, c in self.classes.items() if c in (INSULT, SLIGHT, THREAT)), key=len, reverse=True)
        self.heads = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, heads)) + r")(?![^\W\d_])")
        self.machine = composed(grammar_machines(weights))

    def clauses(self, text: str) -> list[tuple[list[str], float]]:
        """Events and path weight of each clause that has an event."""
        out = []
        low = text.lower()
        if self.heads.search(low) is None:
            return out
        for clause in _CLAUSES.split(low):
            if self.heads.search(clause) is None:
                continue
            classes = [self.classes.get(w.replace("’", "'"), OTHER) for w in _WORDS.findall(clause)]
            events, weight = self.machine.run(classes)
            if events := [e for e in events if e]:
                out.append((events, weight))
        return out

    def events(self, text: str) -> np.ndarray:
        """How often each event occurs in the clauses of the text."""
        return sum((counts(events) for events, _ in self.clauses(text)), np.zeros(len(EVENTS)))


def counts(events: list[str]) -> np.ndarray:
    out = np.zeros(len(EVENTS))
    for e in events:
        out[EVENTS.index(e)] += 1
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.05, start: tuple[np.ndarray, float] = (PRIOR, BIAS)) -> tuple[np.ndarray, float]:
    """Logistic weights of counts by Newton steps, drawn towards the prior weights; they never fall below 0."""
    if len(y) == 0:
        return PRIOR.copy(), BIAS
    z = np.hstack([x, np.ones((len(x), 1))])
    prior, theta = np.append(PRIOR, BIAS), np.append(*start)
    pull = np.append(np.full(len(PRIOR), ridge * 20), ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        grad = z.T @ (p - y) + pull * (theta - prior)
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-6)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -2, 2)
        theta[:-1] = np.maximum(theta[:-1], 0)
        if np.abs(step).max() < 1e-8:
            break
    return theta[:-1], float(theta[-1])


def fit_clauses(docs: list[list[list[float]]], y: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, float]:
    """Weights of events under which the heaviest clause of a document tells its label: choose clauses, fit, and again until the choice rests."""
    w, b = PRIOR.copy(), BIAS
    x = np.zeros((len(docs), len(EVENTS)))
    for turn in range(rounds):
        old = x
        x = np.array([max(d, key=lambda c: (float(np.dot(c, w)), c)) if d else [0.0] * len(EVENTS) for d in docs]).reshape(-1, len(EVENTS))
        if turn and (x == old).all():
            break
        w, b = fit(x, y, start=(w, b))
    return w, b


def _clause_columns(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.float64()))
        for batch in batches:
            # clauses with the same events weigh the same
            rows = [sorted({tuple(counts(events)) for events, _ in grammar.clauses(t)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("text"), pa.array(rows, kind)], names=["doc_id", "toxic", "text", "clauses"])

    return run


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, least_documents: int = LEAST_DOCUMENTS) -> tuple[list[str], np.ndarray, float]:
    """Words to add to the insults, weights of the events and a bias, from a bounded sample of labelled training rows.

    Toxic texts that the grammar does not match can teach it words that no clean text has. A word is added if at least
    least_documents of them have it, after as many different triples of words, and after a quarter as many as there are
    texts: the words that copies of one text have in common are not. All such words of the sample are added.
    """
    rows = taught(docs, one_label(labels, "toxic", max_labelled), "toxic", max_bytes)
    kinds = "doc_id long, toxic int, text string, clauses array<array<double>>"
    seen = cut(rows.mapInArrow(releasing(_clause_columns(Grammar())), kinds), "toxic-clauses")
    missed = (F.col("toxic") == 1) & (F.size("clauses") == 0)
    learned: list[str] = []
    if seen.where(missed).limit(least_documents).count() >= least_documents:
        words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))
        met = seen.groupBy("text").agg(F.max(missed.cast("int")).alias("missed"), F.max((F.col("toxic") == 0).cast("int")).alias("clean")).withColumn("w", words)
        told = met.select("missed", "clean", F.explode(F.array_distinct("w")).alias("word")).where(F.length("word") >= 3)
        usual = told.groupBy("word").agg(F.sum("missed").alias("m"), F.sum("clean").alias("c")).where((F.col("c") == 0) & (F.col("m") >= least_documents))
        beside = F.transform("w", lambda x, i: F.struct(x.alias("word"), *(F.get("w", i - k).alias(f"before_{k}") for k in (1, 2, 3))))
        around = met.where("missed = 1").select(F.explode(beside).alias("x")).select("x.*").distinct().groupBy("word").count()
        # words of the bounded sample, each in least_documents of its texts
        learned = [r.word for r in usual.join(around.where(F.col("count") >= least_documents), "word").where(4 * F.col("count") >= F.col("m")).select("word").orderBy("word").collect()]
    if learned:
        seen = cut(seen.select("doc_id", "toxic", "text").mapInArrow(releasing(_clause_columns(Grammar(learned))), kinds), "toxic-clauses")
    got = seen.select("toxic", "clauses").orderBy("doc_id").collect()  # of the bounded sample: a few numbers for each kind of clause
    w, b = fit_clauses([r.clauses for r in got], np.array([r.toxic for r in got], float))
    return learned, w, b


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, clause_weight, and events (how often each of EVENTS occurs).

    clause_weight is the path weight of the heaviest clause (0 without any), and score its logistic value with the bias.
    Only rows of labels whose crc32 of the id, modulo 4, is not 2 are learned from, at most max_labelled of them and
    max_bytes of their texts; without any, the prior weights score.
    Nulls: a null text is empty and scores as a text without events; a null or other label is no label; a row with a null
    doc_id is left out. Repeated rows are scored each, and ties have no effect; a repeated label counts once, and an id
    with both labels teaches nothing. Texts are read whole, whatever their length. Other columns of docs and labels are
    not read. An empty table gives no rows.
    """
    learned, w, b = learn(docs, labels, max_labelled, max_bytes, least_documents)
    grammar = Grammar(learned, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grammar.clauses(t) for t in batch.column("text").to_pylist()]
            heaviest = np.array([max((weight for _, weight in f), default=0.0) for f in found])
            events = [sum((counts(e) for e, _ in f), np.zeros(len(EVENTS))).astype(int).tolist() for f in found]
            score = 1 / (1 + np.exp(-np.clip(heaviest + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(heaviest, pa.float64()), pa.array(events, pa.list_(pa.int32()))], names=["doc_id", "score", "clause_weight", "events"])

    out = documents(docs).mapInArrow(releasing(run), "doc_id long, score double, clause_weight double, events array<int>")
    return out.select("doc_id", (~is_training("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clause_weight", "events")
