"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as symbols: insult, threat, target, negation, reported speech, other. Five small
transducers each mark one thing, and their composition is one machine that reads a clause once:

* target: whether an addressee stands within `NEAR` words before,
* negation: whether a negation stands within `SCOPE` words before,
* reported speech: whether a verb of saying came earlier in the clause,
* insult and threat: turn the marked symbols into matches.

What is scored are matched clauses: each clause counts once for each kind of match in it. The score
is a logistic function of the counts per kind (to `MOST_CLAUSES`); its weights are fitted by Newton
steps on at most about `MOST_ROWS` labelled rows, picked by a hash of the id when there are more.
The same rows extend the insult words by words and by stems (beginnings of longer words, written
with a `+`) that occur in at least `LEAST_SHARE` of the toxic texts and hardly any other; equal
texts of one label count once there, near copies each.
Without labelled rows of both kinds the weights in `PLAIN` hold.

Defined results: null and empty texts have no match and get the score of the bias; rows without a
label teach nothing; a doubly labelled row teaches twice; equal texts get equal scores. Only id and
text are read for a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import schema, settle, text_key

MOST_ROWS = 20_000
MOST_CLAUSES = 4
LEAST_SHARE, LEAST_TEXTS, MOST_CLEAN = 0.02, 5, 0.02
STEM = range(3, 13)  # lengths of stems that can be learned
NEAR, SCOPE = 4, 3

# Words of each symbol.
INSULT = """idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns dumb
fool fools jerk bastard imbecile vermin garbage creep freak coward retard ugly filthy bitch asshole shit dumbass
dummkopf arschloch abschaum trottel depp wertlos ekelhaft widerlich blödmann versager
imbécile crétin connard salaud ordure minable débile abruti dégoûtant
idiota imbécil estúpido estúpida basura inútil asqueroso patético escoria tonto""".split()
THREAT = """kill murder destroy hurt beat shoot stab hang burn strangle slaughter
töten umbringen vernichten erschießen tuer détruire frapper égorger matar destruir golpear degollar""".split()
TARGET = """you your yours u he she they him her them these those people
du dich dir ihr euch sie tu toi vous te ils elles usted ustedes tú ellos ellas""".split()
NEGATION = "not no never neither nor nobody without don't isn't aren't won't kein keine nicht niemals pas jamais nunca jamás".split()
REPORTED = """said says say wrote writes told reported reports claimed claims quoted quotes alleged
sagte schrieb berichtete dit écrit rapporté dijo escribió""".split()

#: Kinds of match: (insult or threat, targeted, negated, reported).
KINDS = list(product(("insult", "threat"), (False, True), (False, True), (False, True)))
#: Weights without labels: bias first.
PLAIN = np.array([-3.0] + [1.5 + t + (k == "threat") - 1.5 * n - r for k, t, n, r in KINDS])

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


class Transducer:
    """arcs[state][symbol] = (next state, output); unlisted symbols keep their name and go to `other`."""

    def __init__(self, arcs: dict, start):
        self.arcs, self.start = arcs, start

    def then(self, after: Transducer) -> Transducer:
        """The composition: `after` reads what this machine writes."""
        arcs, start = {}, (self.start, after.start)
        todo = [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for symbol, (mine, written) in self.arcs[state[0]].items():
                theirs, output = after.arcs[state[1]][written]
                arcs[state][symbol] = ((mine, theirs), output)
                todo.append((mine, theirs))
        return Transducer(arcs, start)

    def run(self, symbols) -> Iterator:
        state, arcs = self.start, self.arcs
        for symbol in symbols:
            state, output = arcs[state][symbol]
            yield output


SYMBOLS = ("insult", "threat", "target", "negation", "reported", "other")


def _marked(count: int) -> list[tuple]:
    """Symbols that already carry `count` marks."""
    return [(s, *marks) for s in SYMBOLS for marks in product((False, True), repeat=count)]


def marker(trigger: str, reach: int | None, before: int) -> Transducer:
    """Adds a mark: whether `trigger` came within `reach` words before (None: anywhere before)."""
    top = reach or 1
    arcs = {}
    for left in range(top + 1):
        arcs[left] = {}
        for symbol in _marked(before):
            fade = left if reach is None else max(left - 1, 0)
            arcs[left][symbol] = (top if symbol[0] == trigger else fade, (*symbol, left > 0))
    return Transducer(arcs, 0)


def matcher(kind: str) -> Transducer:
    """Writes marked symbols of `kind` as matches and leaves what another matcher has written."""
    arcs = {s: (0, ("match", *s) if s[0] == kind else s) for s in _marked(3)}
    arcs.update({("match", *s): (0, ("match", *s)) for s in _marked(3)})
    return Transducer({0: arcs}, 0)


def grammar() -> Transducer:
    start = Transducer({0: {s: (0, (s,)) for s in SYMBOLS}}, 0)
    marks = start.then(marker("target", NEAR, 0)).then(marker("negation", SCOPE, 1)).then(marker("reported", None, 2))
    return marks.then(matcher("insult")).then(matcher("threat"))


def lexicon() -> dict[str, str]:
    words = {}
    for symbol, listed in (("reported", REPORTED), ("negation", NEGATION), ("target", TARGET), ("threat", THREAT), ("insult", INSULT)):
        words.update(dict.fromkeys(listed, symbol))
    return words


class Scorer:
    def __init__(self, learned: list[str] = (), weights: np.ndarray = PLAIN):
        self.words, self.weights, self.machine = lexicon(), np.asarray(weights), grammar()
        self.words.update((w, "insult") for w in learned if w[-1] != "+")
        self.stems = {s[:-1] for s in learned if s[-1] == "+"}
        self.lengths = sorted(map(len, self.stems))
        triggers = [w for w, s in self.words.items() if s in ("insult", "threat")]
        self.heads = {w[: STEM.start] for w in [*triggers, *learned]}
        self.place = {("match", *kind): i for i, kind in enumerate(KINDS)}

    def symbol(self, word: str) -> str:
        known = self.words.get(word)
        if known is None:
            found = any(n < len(word) and word[:n] in self.stems for n in self.lengths)
            known = "insult" if found else "other"
        return known

    def triggered(self, words: list[str]) -> bool:
        """Whether there is an insult or threat; most texts and clauses end here."""
        like = [w for w in set(words) if w[: STEM.start] in self.heads]
        return any(self.symbol(w) in ("insult", "threat") for w in like)

    def matches(self, text: str | None) -> np.ndarray:
        """Matched clauses per kind."""
        counts = np.zeros(len(KINDS))
        text = (text or "").lower()
        if not self.triggered(_WORD.findall(text)):
            return counts
        for clause in _CLAUSE.split(text):
            words = _WORD.findall(clause)
            if self.triggered(words):
                for output in {o for o in self.machine.run(map(self.symbol, words)) if o[0] == "match"}:
                    counts[self.place[output]] += 1
        return counts

    def features(self, texts: list[str | None]) -> np.ndarray:
        found = np.array([self.matches(t) for t in texts]).reshape(len(texts), len(KINDS))
        return np.minimum(found, MOST_CLAUSES)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + self.features(texts) @ self.weights[1:])))


def stems(counts: dict[str, int]) -> list[str]:
    """Of words and stems that extend one another, the shortest, made longer while it keeps nine in
    ten texts."""
    chosen: dict[str, str] = {}
    for stem in sorted(counts, key=lambda s: (len(s.rstrip("+")), s)):
        start = stem.rstrip("+")
        if not start.startswith(tuple(chosen)):
            longer = [s for s in counts if s.startswith(start) and counts[s] >= 0.9 * counts[stem]]
            chosen[start] = max(longer, key=lambda s: (len(s.rstrip("+")), s))
    return sorted(chosen.values())


def newton(features: np.ndarray, labels: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights of a logistic fit, bias first; the ridge draws the others to PLAIN."""
    x = np.hstack([np.ones((len(features), 1)), features])
    w, pull = PLAIN.copy(), np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - labels) + pull * (w - PLAIN)
        bend = (x.T * (p * (1 - p))) @ x + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most_rows: int = MOST_ROWS) -> dict:
    """{"learned": words, "weights": array} for Scorer. `labels`: (id, label)."""
    marks = labels.select(labels[id_column].alias("id"), labels[label_column].cast("int").alias("toxic"))
    marks = marks.filter("id IS NOT NULL AND toxic IS NOT NULL")
    there = marks.count()
    if there > most_rows:
        chance = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
        marks = marks.filter(chance < most_rows / there)
    texts = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    rows = texts.join(marks, "id").select("text", "toxic").filter("toxic IN (0, 1)")
    # Copies count once; texts that differ anywhere all count.
    once = rows.withColumn("key", text_key(F.col("text"))).groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(_WORD.findall((text or "").lower()))
                found[toxic].update({f"{w[:n]}+" for w in own for n in STEM if n < len(w)} | own)
                found[toxic][""] += 1  # texts
        for toxic, counts in found.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([n if toxic else 0 for n in counts.values()], pa.int64()),
                    pa.array([0 if toxic else n for n in counts.values()], pa.int64()),
                ],
                ["stem", "toxic", "clean"],
            )

    sums = settle(
        once.mapInArrow(count, "stem string, toxic long, clean long")
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("stem") == "") | (F.col("toxic") >= LEAST_TEXTS))
    )
    total = sums.filter("stem = ''").first()
    toxic, clean = (total["toxic"], total["clean"]) if total else (0, 0)
    if not toxic or not clean:
        return {"learned": [], "weights": PLAIN}
    rule = (F.col("toxic") >= LEAST_SHARE * toxic) & (F.col("clean") * toxic <= MOST_CLEAN * clean * F.col("toxic"))
    # At most (stems of a text) / LEAST_SHARE rows meet the rule.
    learned = stems({r["stem"]: r["toxic"] for r in sums.filter(rule & (F.col("stem") != "")).collect()})
    scorer = Scorer(learned)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scorer.features(batch.column(0).to_pylist())
            lists = pa.array(found.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["found", "toxic"])

    # Equal feature rows count together, so that the order of rows leaves no trace in the fit.
    table = (
        rows.mapInArrow(features, "found array<double>, toxic int")
        .groupBy("found", "toxic")
        .count()
        .orderBy("found", "toxic")
        .collect()
    )
    x = np.repeat(np.array([r["found"] for r in table]), [r["count"] for r in table], axis=0)
    y = np.repeat(np.array([r["toxic"] for r in table]), [r["count"] for r in table])
    return {"learned": learned, "weights": newton(x, y)}


def score(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row."""
    scorer = Scorer(model["learned"], model["weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(scorer.score(batch.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["id", "score"])

    plain = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    scored = plain.mapInArrow(run, schema(docs, [(id_column, "id")], "score double"))
    return scored.withColumnRenamed("id", id_column)
