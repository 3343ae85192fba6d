"""Toxicity by a weighted finite-state pattern grammar over clauses.

A sentence is read as a string of word classes: second and third person, copula, negation, report verb,
insult, threat, other words, and the soft ends of clauses.  Insults are a learned lexicon of words and of
productive word beginnings, found by an Aho-Corasick automaton; the other classes are closed lists in four
languages.  Four small transducers, given as arc tables, weigh an insult or a threat:

* ``negation`` damps it within the scope of a negation;
* ``report`` damps it behind a report verb, over clause ends, to the end of the sentence;
* ``target_before`` raises it behind a second person, or behind a third person with a copula;
* ``target_after`` raises it before a vocative ("idiot, you are"), and a threat before its object.

The first three read from the left and are composed into one table of product states; the last reads from
the right.  Two linear passes over a sentence so give each word its left and right state, and these its
weight.  A text's sum of weights, as such and for its length, goes through a logistic regression with a
prior: one full insult stays below one half, one that is aimed, or two, go above.

The lexicon and the regression are learned from at most ``SAMPLE_ROWS`` labelled documents (those with
the smallest hash of their id).  Scores depend on the text alone.  Null and empty texts have no clause
and get the base score.  Without labels of both classes the lexicon is empty.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.plans.iterate import cut

#: Labelled rows that the lexicon and the weights are learned from, at most.
SAMPLE_ROWS = 8_000
#: Entries of the lexicon, at most, the lengths of word beginnings that can become one, and the least
#: weight (log odds less 2.5 standard errors) of an entry.
LEXICON, STEMS, LEAST = 400, (4, 5, 6, 7, 8), 1.0
#: Different words under one beginning that count in a text.
MOST_IN_TEXT = 8
# Closed word classes in English, German, French and Spanish.
SECOND = "you your yours yourself du dich dir dein deine euch tu toi vous votre tú vosotros usted ustedes".split()
THIRD = "he she they er sie il elle ils elles él ella ellos ellas".split()
COPULAS = "are re is s am was were be being bist seid ist sind war waren est sont êtes était es eres son era".split()
NEGATIONS = "not no never neither nor isn aren wasn weren don doesn didn cannot nicht kein keine keinen nie niemals pas jamais aucun ni nunca jamás ningún tampoco".split()
REPORTS = "said says saying told reported claimed claims wrote quote quoted called calls sagte sagt behauptete schrieb dit disait écrit prétend dijo dice escribió afirmó".split()
THREATS = "kill murder hurt destroy stab strangle töten umbringen erschlagen tuer égorger frapper matar golpear destruir".split()
#: Words that a negation and a target before reach over, and a target behind.
NEGATION_SCOPE, BEFORE_SCOPE, AFTER_SCOPE = 4, 3, 2
#: Weights of the arcs: a negated, reported and aimed insult, a threat and an aimed threat.
NEGATED, REPORTED, AIMED, THREAT, AIMED_THREAT = 0.2, 0.3, 1.6, 0.3, 5.0
#: Word classes: other, second person, third person, copula, negation, report verb, insult, threat, soft end.
CLASSES = "XUPCNRIHS"
_CLASS = {w: CLASSES.index(c) for c, ws in (("R", REPORTS), ("N", NEGATIONS), ("C", COPULAS), ("P", THIRD), ("U", SECOND)) for w in ws}
_INSULT, _THREAT, _SOFT = (CLASSES.index(c) for c in "IHS")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[;:,()\[\]{}\"“”«»]")
_HARD = re.compile(r"[.!?\n|]")
#: Prior of the regression: the base, and the weights of a text's sum as such and for its length.
BASE, PRIOR = -6.8, np.array([4.0, 4.0])
#: Code points of a text beyond which its sum counts for its length.
LENGTH = 2000


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(state, class) -> (state, damping, aim)``; state 0 is the start."""

    states: int
    arcs: dict[tuple[int, str], tuple[int, float, float]]


def transducer(states: int, step: Callable[[int, str], int], damp: Callable[[int, str], float] = lambda s, c: 1.0, aim: Callable[[int, str], float] = lambda s, c: 1.0) -> Transducer:
    return Transducer(states, {(s, c): (step(s, c), damp(s, c), aim(s, c)) for s, c in product(range(states), CLASSES)})


def negation() -> Transducer:
    """The state is the number of words that the negation still reaches."""
    return transducer(NEGATION_SCOPE + 1, lambda s, c: NEGATION_SCOPE if c == "N" else 0 if c == "S" else max(s - 1, 0), damp=lambda s, c: NEGATED if s and c in "IH" else 1.0)


def report() -> Transducer:
    return transducer(2, lambda s, c: 1 if c == "R" else s, damp=lambda s, c: REPORTED if s and c in "IH" else 1.0)


def target_before() -> Transducer:
    """States up to the scope: words that the target still reaches; the last: a third person waits for its copula."""
    waits = BEFORE_SCOPE + 1

    def step(s: int, c: str) -> int:
        if c == "U" or c == "C" and s:
            return BEFORE_SCOPE
        return waits if c == "P" else 0 if c == "S" or s == waits else max(s - 1, 0)

    return transducer(waits + 1, step, aim=lambda s, c: AIMED if 0 < s < waits and c == "I" else 1.0)


def target_after() -> Transducer:
    """Reads from the right.  0: a clause end follows, 1: a copula, 2: another word; then the words that a
    vocative (a second person before an end or a copula) still reaches, then those that an object does."""
    vocative, obj = 3, 3 + AFTER_SCOPE

    def step(s: int, c: str) -> int:
        if c == "S":
            return 0
        if c == "U":
            return vocative if s < 2 else obj
        if c == "C":
            return 1
        return s + 1 if s >= vocative and (s - vocative) % AFTER_SCOPE < AFTER_SCOPE - 1 else 2

    return transducer(3 + 2 * AFTER_SCOPE, step, aim=lambda s, c: AIMED if c == "I" and vocative <= s < obj else AIMED_THREAT if c == "H" and s >= vocative else 1.0)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both at once: the states are the pairs that the start reaches, weights multiply."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        s, t = pair = todo.pop()
        for c in CLASSES:
            (s2, d1, a1), (t2, d2, a2) = a.arcs[s, c], b.arcs[t, c]
            if (s2, t2) not in number:
                number[s2, t2] = len(number)
                todo.append((s2, t2))
            arcs[number[pair], c] = (number[s2, t2], d1 * d2, a1 * a2)
    return Transducer(len(number), arcs)


LEFT, RIGHT = compose(compose(negation(), report()), target_before()), target_after()


def _tables(t: Transducer) -> tuple[list[int], list[float], list[float]]:
    rows = [t.arcs[s, c] for s, c in product(range(t.states), CLASSES)]
    return [r[0] * len(CLASSES) for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def weigh(classes: list[int]) -> list[tuple[int, float]]:
    """Places of the insults and threats in a sentence's classes, and the grammar's weight for each."""
    (go, damp, aim), (back, _, behind) = _LEFT, _RIGHT
    found, s = [], 0
    for k, c in enumerate(classes):
        if c == _INSULT or c == _THREAT:
            found.append((k, damp[s + c], aim[s + c]))
        s = go[s + c]
    out, s, end = [], 0, len(classes)
    for k, d, a in reversed(found):
        for c in reversed(classes[k + 1 : end]):
            s = back[s + c]
        end = k + 1
        c = classes[k]
        out.append((k, d * max(a, behind[s + c]) * (THREAT if c == _THREAT else 1.0)))
    return out[::-1]


_LEFT, _RIGHT = _tables(LEFT), _tables(RIGHT)


@dataclass(frozen=True)
class Entry:
    """A word, or with ``stem`` a word's beginning, and its weight from 0 to 1."""

    form: str
    stem: bool
    weight: float


class Grammar:
    """The transducers behind one lexicon."""

    def __init__(self, lexicon: list[Entry]):
        self.trigger = ahocorasick.Automaton()
        arcs: dict[str, list[tuple[int, bool, float, int]]] = {}
        for e in lexicon:
            arcs.setdefault(e.form, []).append((len(e.form), e.stem, e.weight, _INSULT))
        for w in THREATS:
            arcs.setdefault(w, []).append((len(w), False, 1.0, _THREAT))
        for form, ways in arcs.items():
            self.trigger.add_word(form, tuple(ways))
        self.trigger.make_automaton()

    def triggers(self, low: str) -> dict[int, tuple[float, int]]:
        """Starts of words that an insult or threat arc accepts, with the heaviest arc's weight and class."""
        out: dict[int, tuple[float, int]] = {}
        for end, ways in self.trigger.iter(low):
            for size, stem, weight, kind in ways:
                start = end - size + 1
                if (start == 0 or not low[start - 1].isalpha()) and (end + 1 < len(low) and low[end + 1].isalpha()) == stem and weight > out.get(start, (0.0, 0))[0]:
                    out[start] = (weight, kind)
        return out

    def sentence(self, low: str, hits: dict[int, tuple[float, int]], a: int, b: int) -> float:
        """The summed weights of a sentence's insults and threats."""
        classes, weights = [], {}
        for m in _TOKEN.finditer(low, a, b):
            hit = hits.get(m.start())
            if hit:
                weights[len(classes)] = hit[0]
                classes.append(hit[1])
            else:
                word = m.group()
                classes.append(_CLASS.get(word, 0) if word[0].isalpha() else _SOFT)
        return sum(w * weights[k] for k, w in weigh(classes))

    def total(self, text: str | None) -> float:
        """The sum over all sentences of a text."""
        if not text:
            return 0.0
        low = text.lower()
        hits = self.triggers(low)
        if not hits:
            return 0.0
        ends, out, done = [m.start() for m in _HARD.finditer(low)] + [len(low)], 0.0, -1
        for p in sorted(hits):
            k = bisect.bisect_right(ends, p)
            if k != done:
                out += self.sentence(low, hits, ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(low))
                done = k
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        s = self.total(text)
        return math.log1p(s), math.log1p(s * LENGTH / max(LENGTH, len(text or "")))


def _types(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs[toxic].update(_types(text))
    yield from _counted([*(docs[0].keys() | docs[1].keys())], [docs[1], docs[0]], ["form", "toxic", "clean"])


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For beginnings of words: documents that have one, toxic ones that have two words of it, and the different
    words, ``MOST_IN_TEXT`` a document at most."""
    docs, often, several = (Counter(), Counter()), (Counter(), Counter()), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forms = Counter(w[:k] for w in _types(text) for k in STEMS if len(w) > k)
            docs[toxic].update(forms.keys())
            often[toxic].update({f: min(n, MOST_IN_TEXT) for f, n in forms.items()})
            if toxic:
                several.update(f for f, n in forms.items() if n > 1)
    yield from _counted([*(docs[0].keys() | docs[1].keys())], [docs[1], docs[0], often[1], often[0], several], ["form", "toxic", "clean", "toxic_often", "clean_often", "several"])


def _counted(forms: list[str], counts: list[Counter], names: list[str]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(forms), 50_000):
        part = forms[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[f] for f in part], pa.int64()) for c in counts)], names)


def sample_of(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, toxic)`` of at most ``rows`` labelled documents for which ``allowed`` holds of ``id``; of rows
    with equal texts and labels the one with the smallest id."""
    picked = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(allowed)
    picked = picked.orderBy(F.md5(F.col("id").cast("string")), "id", "toxic").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    return texts.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.col("toxic").alias("label")).agg(F.min(F.struct("id", "text", "toxic")).alias("r")).select("r.*")


def learn_lexicon(sample: DataFrame) -> list[Entry]:
    """Beginnings of several words, and other words, that occur more often in toxic documents: their log odds
    stay above ``LEAST`` by 2.5 standard errors.  A beginning must have two different words in two documents;
    of nested ones the heaviest counts, then the longest.  Weights are shares of the heaviest entry's."""
    size = {r.toxic: (r.n, r.size) for r in sample.select("toxic", F.length("text").alias("size")).groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    (t, t_size), (c, c_size) = size.get(1, (0, 0)), size.get(0, (0, 0))
    if not t or not c:
        return []
    rows, error = sample.select("text", "toxic"), "2.5D * sqrt(1 / (toxic + 0.5D) + 1 / (clean + 0.5D))"
    counts = rows.mapInArrow(K.tidied(_stem_counts), "form string, toxic long, clean long, toxic_often long, clean_often long, several long")
    counts = counts.groupBy("form").agg(*(F.sum(k).alias(k) for k in ("toxic", "clean", "toxic_often", "clean_often", "several")))
    counts = counts.withColumn("weight", F.expr(f"ln((toxic_often + 0.5D) / {t_size or 1}) - ln((clean_often + 0.5D) / {c_size or 1}) - {error}"))
    stems = counts.where(f"toxic >= {max(3, t // 200)} and several >= 2 and weight >= {LEAST}D").orderBy(F.desc("weight"), "form").limit(10 * LEXICON).collect()
    kept: list[Entry] = []
    for r in sorted(stems, key=lambda r: (-r.weight, -len(r.form), r.form)):
        if len(kept) < LEXICON // 2 and not any(e.form.startswith(r.form) or r.form.startswith(e.form) for e in kept):
            kept.append(Entry(r.form, True, float(r.weight)))
    under = tuple(e.form for e in kept)
    counts = rows.mapInArrow(K.tidied(_word_counts), "form string, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.withColumn("weight", F.expr(f"ln((toxic + 0.5D) / {t + 1}) - ln((clean + 0.5D) / {c + 1}) - {error}"))
    words = counts.where(f"toxic >= {max(4, t // 200)} and weight >= {LEAST}D").orderBy(F.desc("weight"), "form").limit(10 * LEXICON).collect()
    kept += [Entry(r.form, False, float(r.weight)) for r in words if r.form in under or not r.form.startswith(under)][: LEXICON - len(kept)]
    top = max((e.weight for e in kept), default=1.0)
    return [Entry(e.form, e.stem, e.weight / top) for e in kept]


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 50) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton's method, drawn to ``BASE`` and ``PRIOR``, its weights kept at 0 or more."""
    w = np.concatenate([[BASE], PRIOR])
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    prior = w.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + ridge * (w - prior)
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Model:
    lexicon: tuple[Entry, ...]
    base: float
    weights: tuple[float, ...]

    def scores(self, grammar: Grammar, texts: list[str | None]) -> np.ndarray:
        x = np.array([grammar.features(t) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.base, -30, 30)))


def _features(lexicon: list[Entry]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["whole", "share", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample = cut(sample_of(docs, labels, allowed, rows, id_col, text_col))  # one scan of the documents
    lexicon = learn_lexicon(sample)
    if not lexicon:
        return Model((), BASE, tuple(PRIOR))
    got = sample.select("text", "toxic").mapInArrow(K.tidied(_features(lexicon)), "whole double, share double, toxic int").toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)
    base, weights = fit_weights(got[["whole", "share"]].to_numpy(), got.toxic.to_numpy().astype(float))
    return Model(tuple(lexicon), base, tuple(weights))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the score (0 to 1) in a last column; of its own columns, one of that name gives way to it."""
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(list(model.lexicon))
        for batch in batches:
            for a, b in K.chunks(batch.column(at)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(grammar, part.column(at).to_pylist()))], [*part.schema.names, score_col])

    return docs.mapInArrow(K.tidied(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, whatever their other columns are called."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(list(model.lexicon))
        for batch in batches:
            for a, b in K.chunks(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(model.scores(grammar, part.column(at).to_pylist()) < limit))

    return docs.mapInArrow(K.tidied(run), docs.schema)
