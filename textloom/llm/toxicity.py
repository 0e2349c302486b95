"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses of word classes. Five small transducers read them side by side, as
one composed machine whose state is the tuple of theirs: *insult* emits the learned weight of a
word, *threat* emits one for harm, more after words of intent; *target*, *negation* and *reported
speech* emit factors on what the first two emit while their scope lasts. Clauses begin anew, so
a negation or a quotation reaches no further than its clause. A text's total is the sum over its
matched clauses, and a logistic curve turns it into a score.

Insult weights are log-odds of words and word beginnings in toxic against other labelled
texts; the curve is fitted on labelled texts kept from the weights. Both come from at most about
``rows`` labelled rows, and at most ``entries`` words are kept, which bounds the model, not what
is scored: every text is scored whole. Null and empty texts have total 0. Rows without label
are scored only; equal texts count once when learning, and so do near copies, texts linked by a
Jaccard similarity of 0.8 or more of their five-word shingles. With no labels at all every text scores 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import nearcopies
from textloom.llm.common import free_name, slices, text_key
from textloom.runtime import cut

# Words that give the grammar its scopes, in the languages of the tables.
TARGET = "you your yours yourself u ur they them he she him her du dich dir dein deine euch ihr tu te toi ton ta vous vos tú ti usted ustedes vosotros".split()
NEGATION = "not no never none nobody neither nor isn aren wasn don doesn won kein keine keinen nicht nie niemals ne pas jamais aucun nunca jamás ni tampoco sin without".split()
REPORTED = "said says called calls wrote claims claimed quote quoted reported sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split()
INTENT = "will gonna shall going must werde werden wird vais va vas allons voy vamos".split()
HARM = "kill hurt murder destroy shoot stab beat töten umbringen schlagen tuer frapper massacrer matar golpear".split()

OTHER, END, HIT, TARGETS, NEGATES, REPORTS, INTENDS, HARMS = range(8)
_SCOPES = {TARGETS: TARGET, NEGATES: NEGATION, REPORTS: REPORTED, INTENDS: INTENT, HARMS: HARM}
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_QUOTES = re.compile(r"[\"“”«»„]")
HARM_WEIGHT = 2.0
#: The likelihood ratio that one word in a thousand reaches by chance; thousands are tried.
CHANCE = 10.83


@dataclass(frozen=True)
class Transducer:
    """Opens a scope of ``reach`` words at a class; within it ``factor`` is emitted, outside ``rest``."""

    opens: int
    reach: int
    factor: float
    rest: float = 1.0

    def step(self, state: int, kind: int) -> tuple[int, float]:
        if kind == END:
            return 0, self.rest
        emitted = self.factor if state else self.rest
        return (self.reach if kind == self.opens else max(0, state - 1)), emitted


INTENTION = Transducer(INTENDS, 3, 1.5, 0.5)
AIM = Transducer(TARGETS, 4, 1.25)
DENIAL = Transducer(NEGATES, 3, 0.5)
REPORT = Transducer(REPORTS, 1 << 30, 0.6)


class Machine:
    """The composition of the transducers; moves are worked out when first met."""

    def __init__(self, *parts: Transducer) -> None:
        self.parts, self.start = parts, (0,) * len(parts)
        self.moves: dict[tuple, tuple[tuple, tuple]] = {}

    def step(self, state: tuple, kind: int) -> tuple[tuple, tuple]:
        move = self.moves.get((state, kind))
        if move is None:
            pairs = [p.step(s, kind) for p, s in zip(self.parts, state)]
            move = self.moves[state, kind] = (tuple(p[0] for p in pairs), tuple(p[1] for p in pairs))
        return move


@dataclass
class Model:
    """Word and beginning weights, and the curve; ``total`` scores one text by the grammar."""

    words: dict[str, float]
    beginnings: dict[str, float]
    slope: float = 0.0
    offset: float = -30.0
    _kinds: dict[str, tuple[int, float]] = field(default_factory=dict)
    _machine: Machine = field(default_factory=lambda: Machine(INTENTION, AIM, DENIAL, REPORT))

    def __getstate__(self):
        return {"words": self.words, "beginnings": self.beginnings, "slope": self.slope, "offset": self.offset}

    def __setstate__(self, state):
        self.__init__(**state)

    def kind(self, word: str) -> tuple[int, float]:
        found = self._kinds.get(word)
        if found is None:
            if len(self._kinds) > 300_000:
                self._kinds.clear()
            weight = self.words.get(word)
            if weight is None:
                weight = max((self.beginnings.get(word[:n], 0.0) for n in range(3, len(word))), default=0.0)
            if weight:
                found = (HIT, weight)
            elif not word[0].isalpha():
                found = (END, 0.0)
            else:
                found = next(((k, HARM_WEIGHT if k == HARMS else 0.0) for k, ws in _SCOPES.items() if word in ws), (OTHER, 0.0))
            self._kinds[word] = found
        return found

    def total(self, text: str | None) -> float:
        if not text:
            return 0.0
        words = _TOKEN.findall(text.lower())
        if not any(self.kind(w)[1] for w in set(words)):
            return 0.0
        quoted = bool(_QUOTES.search(text))
        total, machine = 0.0, self._machine
        state = machine.start
        for word in words:
            kind, weight = self.kind(word)
            state, (intent, aim, denial, report) = machine.step(state, kind)
            if weight:
                total += weight * (intent if kind == HARMS else 1.0) * aim * denial * report * (0.9 if quoted else 1.0)
        return total

    def score(self, total: float) -> float:
        z = self.slope * log(1 + total) + self.offset
        return 1 / (1 + exp(-z)) if z > -700 else 0.0


def _weights(table: DataFrame, toxic: int, clean: int, name: str, least: int, entries: int) -> dict[str, float]:
    weight = F.log((F.col("t") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / F.lit(clean + 1.0))
    best = table.filter(F.col("t") >= least).withColumn("w", weight).filter(F.col("w") >= 3.0)
    best = best.orderBy(F.desc(F.col("w") * F.sqrt("t")), name).limit(entries)
    return {r[name]: _backed(float(r["w"]), int(r["t"]), int(r["n"]), toxic, clean) for r in best.select(name, "w", "t", "n").collect()}


def _backed(weight: float, t: int, n: int, toxic: int, clean: int) -> float:
    """``weight`` drawn toward 0 by as much as chance may have made it: by the likelihood ratio of its counts."""
    share, base = t / n, toxic / (toxic + clean)
    ratio = 2 * (t * log(share / base) + ((n - t) * log((1 - share) / (1 - base)) if n > t and clean else 0.0))
    return weight * ratio / (ratio + CHANCE) if ratio > 0 else weight


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve over ln(1 + total), by damped Newton steps with a small ridge."""
    x = np.log1p(np.array([b[0] for b in bins]))
    y, n = np.array([b[1] for b in bins], float), np.array([b[2] for b in bins], float)
    design, beta, ridge = np.stack([x, np.ones_like(x)], 1), np.zeros(2), np.array([0.05, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - n * p) - ridge * beta
        curvature = design.T @ (design * (n * p * (1 - p))[:, None]) + np.diag(ridge)
        move = np.linalg.solve(curvature, gradient)
        beta = beta + move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    rows: int = 20_000,
    entries: int = 20_000,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """Learn from labelled rows where ``learnable`` (a condition on ``key``) holds."""
    marked = labels.filter(learnable & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("toxic"))
    known = marked.count()
    if not known:
        return Model({}, {})
    drawn = F.pmod(F.xxhash64(F.lit("toxicity"), "k"), F.lit(1 << 30)) < F.lit(int(min(1.0, rows / known) * (1 << 30)))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), *text_key(F.col(text))).filter(F.col("text").isNotNull())
    sample = texts.filter(drawn).join(marked.filter(drawn), "k")
    sample = sample.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = cut(sample.withColumn("fold", F.pmod("t2", F.lit(5)).cast("int")), "toxicity-sample")
    weighing = sample.filter("fold <> 0")
    near = nearcopies.classed(weighing.select("t1", "text"), key="t1").select("t1", "t2", F.coalesce("root", "f").alias("family"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = [[w for w in set(_TOKEN.findall(t.as_py().lower())) if w[0].isalpha()] for t in batch.column("text")]
            times = [len(f) for f in found]
            mark, family = (np.repeat(batch.column(c).to_numpy(), times) for c in ("toxic", "family"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for f in found for w in f], pa.string()), pa.array(mark, pa.int64()), pa.array(family, pa.int64())],
                ["word", "t", "family"],
            )

    # near copies count as one text
    weighing = weighing.join(near, ["t1", "t2"]).select("text", "toxic", "family")
    spelled = weighing.mapInArrow(spell, "word string, t bigint, family bigint")
    spelled = cut(spelled.distinct(), "toxicity-spelled")
    sizes = spelled.select("family", "t").distinct().agg(F.count(F.lit(1)), F.sum("t")).first()
    toxic, clean = int(sizes[1] or 0), int(sizes[0] - (sizes[1] or 0))
    words = cut(spelled.groupBy("word").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")), "toxicity-words")
    least = max(3, toxic // 200)
    starts = words.select(
        F.explode(F.transform(F.sequence(F.lit(3), F.lit(7)), lambda n: F.when(F.char_length("word") > n, F.substring("word", F.lit(1), n)))).alias("start"),
        "t",
        "n",
    ).filter("start is not null")
    starts = starts.groupBy("start").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))
    model = Model(
        _weights(words, toxic, clean, "word", least, entries),
        _weights(starts.filter("forms >= 3"), toxic, clean, "start", 2 * least, entries),
    )
    fold = totals(sample.filter("fold = 0").select("text", "toxic"), model)
    bins = fold.groupBy(F.round(F.least("total", F.lit(200.0)), 1).alias("x")).agg(F.sum("toxic"), F.count(F.lit(1))).collect()
    if bins:
        model.slope, model.offset = _curve(sorted((float(b[0]), int(b[1]), int(b[2])) for b in bins))
    return model


def totals(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the grammar's ``total`` and the ``score``.

    These two names get underscores in front where ``docs`` has columns of the same names.
    """
    kept = [f for f in docs.schema.fields if f.name != text]
    added = [free_name(docs, n) for n in ("total", "score")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{n}` double" for n in added)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [model.total(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(found, pa.float64()), pa.array([model.score(t) for t in found], pa.float64())],
                [*(f.name for f in kept), *added],
            )

    return docs.mapInArrow(work, schema)
