"""Toxicity by a weighted grammar of finite-state transducers over the words of a clause.

Words become symbols: insult, threat, modal, target, negation, report, other.  Transducers rewrite the symbols one
after another and are composed into one machine: negation marks what its scope holds, reported speech marks what
follows a report, target marks insults and threats aimed at someone, threat keeps only threats that a modal or a
target supports, and the scorer turns each marked insult or threat into its kind.  A document's score is logistic in
its numbers of matched clauses of each kind, so a word counts by the clause that it stands in.

What is learned, from a bounded sample of labelled rows: insults (words, and stems as beginnings of words, that stand
in enough toxic texts and in next to no other) and the weights of the kinds, drawn to fixed prior weights.  Near
copies in the sample count once, else the words of a copied text would look like insults.

Defined cases: a null or empty text matches nothing and has the base score; null labels aren't learned from; a doc_id
labelled twice counts as toxic if any of its labels says so; without any toxic label in the sample only the fixed
words are used; a row with a null doc_id is scored, isn't held out and isn't learned from; repeated rows each give a
row; a very long text is one text like any other; an empty table gives no rows; other columns aren't looked at, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common as C

#: The most rows of the sample, by label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 6000

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT = range(7)

# Words of the closed classes, in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash clown clowns pathetic worthless disgusting imbecile dumb fool jerk creep vermin dumm trottel abschaum widerlich imbécile débile ordure minable estúpido imbécil escoria patético"
THREATS = "kill hurt beat destroy smash stab shoot burn crush die töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir"
MODALS = "will shall gonna must should 'll werde werden wirst sollst vais va vas doit voy vas deberías"
TARGETS = "you your yours u ur he she they them him her his du dich dir dein ihr euch tu toi te vous votre ton tú ti usted ustedes vosotros"
NEGATIONS = "not no never isn't aren't don't nobody nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco"
REPORTS = "said says say called calls wrote writes claimed quoted reported sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió"


class Marked(NamedTuple):
    """A symbol with the marks that transducers have added."""

    base: int
    negated: bool = False
    reported: bool = False
    targeted: bool = False


class Transducer(NamedTuple):
    """step(state, symbol) gives the next state and the symbol put out; states start at ``start``."""

    start: object
    step: object

    def __or__(self, then: Transducer) -> Transducer:
        """Composition: what this one puts out is what the other reads."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = then.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, then.start), step)


def _hits(x) -> bool:
    return x.base in (INSULT, THREAT)


def negation(scope: int = 3) -> Transducer:
    def step(left, x):
        if x.base == NEGATION:
            return scope, x
        return max(0, left - 1), x._replace(negated=True) if left and _hits(x) else x

    return Transducer(0, step)


def reported_speech() -> Transducer:
    def step(inside, x):
        return inside or x.base == REPORT, x._replace(reported=True) if inside and _hits(x) else x

    return Transducer(False, step)


def target() -> Transducer:
    def step(aimed, x):
        return aimed or x.base == TARGET, x._replace(targeted=True) if aimed and _hits(x) else x

    return Transducer(False, step)


def threat() -> Transducer:
    def step(modal, x):
        if x.base == THREAT and not (modal or x.targeted):
            return modal, Marked(OTHER)
        return modal or x.base == MODAL, x

    return Transducer(False, step)


KINDS = list(product((INSULT, THREAT), (False, True), (False, True), (False, True)))


def insult() -> Transducer:
    """Puts out the kind of each marked insult or threat, and None for all else."""
    kinds = {Marked(*k): i for i, k in enumerate(KINDS)}
    return Transducer(0, lambda s, x: (s, kinds.get(x)))


class Machine:
    """The composition as tables: next state and kind (-1: none) by state and symbol."""

    def __init__(self) -> None:
        whole = negation() | reported_speech() | target() | threat() | insult()
        states, self.next, self.kind = {whole.start: 0}, [], []
        todo = [whole.start]
        for state in todo:
            row = [whole.step(state, Marked(x)) for x in range(7)]
            for s, _ in row:
                if s not in states:
                    states[s] = len(states)
                    todo.append(s)
            self.next.append([states[s] for s, _ in row])
            self.kind.append([-1 if k is None else k for _, k in row])

    def kinds(self, symbols: list[int]) -> set[int]:
        """Kinds that a clause holds."""
        state, found = 0, set()
        for x in symbols:
            if (k := self.kind[state][x]) >= 0:
                found.add(k)
            state = self.next[state][x]
        return found


def prior() -> np.ndarray:
    """Base weight, and a weight for each kind: aimed more, negated or reported less."""
    return np.array([-4.0] + [3.0 + t - 2.0 * n - 2.0 * r for _, n, r, t in KINDS])


class Lexicon(NamedTuple):
    """Learned insults: whole words, and beginnings of words by their length in bytes."""

    words: list[str]
    stems: list[str]


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        self.machine = Machine()
        table: dict[bytes, int] = {}
        for text, symbol in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (MODALS, MODAL), (THREATS, THREAT), (INSULTS, INSULT)):
            table |= dict.fromkeys((w.encode() for w in text.split()), symbol)
        table |= dict.fromkeys((w.encode() for w in lexicon.words), INSULT)
        self.word_hash, self.word_symbol = self._sorted(table)
        by: dict[int, dict[bytes, int]] = {}
        for s in lexicon.stems:
            by.setdefault(len(s.encode()), {})[s.encode()] = INSULT
        self.stems = {n: self._sorted(t)[0] for n, t in sorted(by.items())}
        self.inside = np.zeros(256, bool)
        self.inside[0x61:0x7B] = self.inside[0x80:] = self.inside[0x27] = True
        self.edge = np.zeros(256, bool)
        self.edge[[ord(c) for c in ".!?;\n"]] = True

    @staticmethod
    def _sorted(table: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(table), np.uint8)
        ends = np.cumsum([len(w) for w in table]) if table else np.zeros(0, np.int64)
        h = C.range_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64) if table else ends, ends)
        order = np.argsort(h)
        return h[order], np.array(list(table.values()), np.int64)[order] if table else np.zeros(0, np.int64)

    @staticmethod
    def _look(h: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, h), max(0, len(table) - 1))
        return at, table[at] == h if len(table) else np.zeros(len(h), bool)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Matched clauses of each kind of each text."""
        out, slices = [], (s for own in C.slices(texts) for s in C.slices(pc.utf8_lower(texts.slice(own.first, own.n)), 1 << 62))
        for s in slices:
            found = np.zeros((s.n, len(KINDS)))
            w = C.words(s.data, s.offsets, self.inside)
            if len(w.doc):
                symbol = np.zeros(len(w.doc), np.int64)
                length = w.end - w.start
                for n, table in self.stems.items():
                    long = np.flatnonzero(length >= n)
                    h = C.range_hashes(s.data, w.start[long], w.start[long] + n)
                    symbol[long[self._look(h, table)[1]]] = INSULT
                at, same = self._look(w.hash, self.word_hash)
                symbol[same] = self.word_symbol[at[same]]
                clause = np.cumsum(self.edge[s.data])[w.start] + w.doc  # grows with each document, so none is shared
                hit = np.unique(clause[(symbol == INSULT) | (symbol == THREAT)])
                low, high = np.searchsorted(clause, hit, "left"), np.searchsorted(clause, hit, "right")
                for a, b in zip(low.tolist(), high.tolist(), strict=True):
                    for k in self.machine.kinds(symbol[a:b].tolist()):
                        found[w.doc[a], k] += 1
            out.append(found)
        return np.concatenate(out) if out else np.zeros((0, len(KINDS)))


def _features(counts: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(counts)), np.log2(1 + counts)])


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray


_WORD = re.compile(r"[^\W\d_]+")
STEM_LENGTHS = range(3, 9)


def _terms(text: str | None) -> set[tuple[bool, str]]:
    """(whole, string) of a text: its words and their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    return {(True, w) for w in words} | {(False, w[:n]) for w in words for n in STEM_LENGTHS if len(w) >= n}


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two least hashes of five words of each text."""
    for b in batches:
        least = []
        for text in b.column("text").to_pylist():
            raw = np.frombuffer((text or "").lower().encode(), np.uint8)
            w = C.words(raw, np.array([0, len(raw)]), C.space_words()).hash
            h = C.rolling(w, min(5, max(1, len(w))))
            least.append([int(x) for x in (h.view(np.int64).min(), C.mix(h).view(np.int64).min())] if len(h) else [0, 0])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([x[0] for x in least], pa.int64()), pa.array([x[1] for x in least], pa.int64())], ["doc_id", "toxic", "a", "b"])


def sample(docs: DataFrame, labels: DataFrame, rows, toxic: int, clean: int) -> DataFrame:
    """doc_id, text, toxic of labelled rows that the condition admits, so many of each label at most, by a hash of the id."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(rows)
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order).limit(toxic).unionByName(known.where("toxic = 0").orderBy(order).limit(clean))
    return C.stored(C.text_of(docs).join(F.broadcast(ids), "doc_id"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, rows="true", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Lexicon and weights from the labelled rows that the condition ``rows`` on doc_id admits."""
    spark = docs.sparkSession
    chosen = sample(docs, labels, F.expr(rows), toxic, clean)
    known = sorted((r.doc_id, r.toxic, r.a, r.b) for r in chosen.mapInArrow(_sketches, "doc_id long, toxic int, a long, b long").collect())
    seen: set[tuple] = set()
    keep: dict[int, int] = {}
    for doc_id, label, a, b in known:
        if not {("a", a), ("b", b)} & seen:
            keep[doc_id] = label
        seen |= {("a", a), ("b", b)}
    kept = frozenset(keep)
    n = Counter(keep.values())
    least = max(5, n[1] // 100)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter(t for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if i in kept for t in _terms(text))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.bool_()), pa.array([s for _, s in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["whole", "term", "n"])

    schema = "whole boolean, term string, n long"
    counted = chosen.where("toxic = 1").mapInArrow(terms, schema).groupBy("whole", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    positive = {(r.whole, r.term): r.n for r in counted.collect()}
    wanted = frozenset(positive)

    def negative_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter(t for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if i in kept for t in _terms(text) & wanted)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.bool_()), pa.array([s for _, s in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["whole", "term", "n"])

    negative = {(r.whole, r.term): r.n for r in chosen.where("toxic = 0").mapInArrow(negative_terms, schema).groupBy("whole", "term").agg(F.sum("n").alias("n")).collect()}
    sure = {t for t, k in positive.items() if 50 * negative.get(t, 0) <= k} if n[0] else set()
    longer = {(False, s[:-1]) for w, s in sure if not w and positive[False, s] == positive.get((False, s[:-1]))}
    stems = sorted(s for w, s in sure if not w and (False, s) not in longer)
    lexicon = Lexicon(sorted(s for w, s in sure if w), stems)

    sent = spark.sparkContext.broadcast(lexicon)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(sent.value)
        for b in batches:
            found = m.counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.tolist(), pa.list_(pa.float64()))], ["doc_id", "counts"])

    rows_ = [(r.counts, keep[r.doc_id]) for r in chosen.mapInArrow(matched, "doc_id long, counts array<double>").collect() if r.doc_id in kept]
    weights = prior()
    if n[1] and n[0]:
        weights = logistic(_features(np.array([r[0] for r in rows_])), np.array([r[1] for r in rows_], float), weights)
    return Model(lexicon, weights)


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, pull: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights by Newton's method; ``pull`` draws them to start."""
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * (w - start)
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(texts: DataFrame, model: Model) -> DataFrame:
    """The rows (a column ``text``, and others to carry along) with a column ``score`` more, from 0 to 1."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(sent.value.lexicon)
        for b in batches:
            logit = _features(m.counts(b.column("text"))) @ sent.value.weights
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], [*b.schema.names, "score"])
        C.release()

    return texts.mapInArrow(run, StructType([*texts.schema.fields, StructField("score", DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, held_out: str, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; rows for which ``held_out`` holds aren't learned from."""
    model = fit(docs, labels, f"not ({held_out})")
    return score(C.text_of(docs), model).select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score stays under the threshold."""
    model = fit(docs, labels)
    kept = score(C.beside(docs, text=F.col("text").cast("string")), model).where(F.col("score") < threshold)
    return C.rows_of(kept, docs.columns)
