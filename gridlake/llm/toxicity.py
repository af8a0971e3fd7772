"""Toxicity by a weighted finite-state grammar of clauses.

Words are read as symbols: four levels of insult, threat, target (whom it is aimed at), negation, reported
speech, other. Four small transducers pass on or rewrite these symbols and add weights: one weakens what is
negated, one what is reported, one strengthens insults with a target near, one counts threats only with a
target near. They are composed into one table, which reads each clause from its start; the weight of its path
is the clause's score, so a matched clause counts and not a word on its own. A logistic function of a
document's clause scores (their sum, sum by length, number, greatest) is its score.

The insult lexicon is a few fixed words and stems learned here: word beginnings that stand in toxic documents
far oftener than in others. Stems and the logistic function are learned on a bounded sample of the labelled
rows that may be learned from (TRAIN_TOXIC and TRAIN_CLEAN distinct texts, chosen by hash), never from those
held out. Labels, language, source and id are no inputs of a score.

Cases: a null or empty text has no clauses and gets the score of a text without matches. Texts are read whole.
Labels that are null, or whose document is missing or has no id, teach nothing; a document without id is scored
as the others and is not held out; a document with several labels counts as
toxic if one says so; without any labels a fixed function of the fixed words scores. Repeated rows give
repeated results; an empty table gives an empty one. `score` returns its own columns only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lexicons in four languages.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid loser losers scum trash worthless pathetic disgusting clown clowns dumb imbecile bastard "
    "bitch asshole freak vermin filth subhuman retard dummkopf trottel arschloch abschaum drecksack versager dumm hurensohn missgeburt "
    "connard connasse salaud abruti débile crétin ordure pourriture imbécile minable estúpido estúpida imbécil gilipollas basura escoria cabrón inútil idiota patético"
).split()
THREATS = (
    "kill hurt destroy murder beat burn shoot stab hang töten umbringen vernichten verprügeln schlagen erschießen "
    "tuer frapper détruire brûler égorger matar golpear destruir quemar apuñalar"
).split()
TARGETS = (
    "you your yours yourself u ur they them their those people du dich dir dein deine ihr euch eure sie tu te toi ton tes vous vos votre eux tú ti usted ustedes vosotros ellos vuestra"
).split()
NEGATIONS = "not no never isn't aren't don't won't nobody nicht kein keine nie niemals niemand pas jamais aucun aucune nunca ningún ninguna nadie tampoco".split()
REPORTS = (
    "said says told claimed claims wrote writes quoted called reported according sagte sagt schrieb nannte behauptet laut "
    "dit disait écrit prétend selon dijo dice escribió según llamó"
).split()

#: At most so many labelled documents of each label are learned from.
TRAIN_TOXIC, TRAIN_CLEAN = 5_000, 15_000
#: Lengths of word beginnings; what a learned stem needs; most stems that are kept.
STEM_LENGTHS, MIN_TOXIC, MIN_SHARE, MIN_WEIGHT, MIN_EVIDENCE, MOST_STEMS = range(3, 11), 4, 0.01, 1.5, 20.0, 400
#: Log-odds from which a stem is an insult of the second, third and fourth level.
LEVELS = (2.0, 3.0, 4.5)
CUT = 0.7

OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = 0, 1, 2, 3, 4, 5  # insults have symbols 5 to 8
WEAK, NEAR = 10, 4  # added to a symbol that was weakened; for how many words context holds
SYMBOLS = range(9)
END_CLAUSE = -1
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;\n]")
REMEMBERED = 300_000

#: A transducer: state and symbol to (symbol passed on, weight, next state). What is missing passes on, with
#: weight 0, and counts a state down by one.
Transducer = dict[tuple[int, int], tuple[int, float, int]]


def _fades(mark: int, hit) -> Transducer:
    """States 0 to NEAR: how long the symbol `mark` stays near. `hit` says what becomes of a symbol near it."""
    t: Transducer = {}
    for state in range(NEAR + 1):
        for s in (*SYMBOLS, *(s + WEAK for s in SYMBOLS)):
            out, weight = hit(s) if state else (s, 0.0)
            t[state, s] = (out, weight, NEAR if s == mark else max(0, state - 1))
    return t


def negation() -> Transducer:
    return _fades(NEGATION, lambda s: (s + WEAK, 0.0) if THREAT <= s < WEAK else (s, 0.0))


def reported() -> Transducer:
    """What is reported stays so to the end of the clause."""
    t: Transducer = {}
    for state in (0, 1):
        for s in (*SYMBOLS, *(s + WEAK for s in SYMBOLS)):
            out = s + WEAK if state and THREAT <= s < WEAK else s
            t[state, s] = (out, 0.0, 1 if s == REPORT else state)
    return t


def insult() -> Transducer:
    """Weighs insults by level, weakened ones by a third of it."""
    t: Transducer = {}
    for s in SYMBOLS:
        level = max(0, s - INSULT + 1)
        t[0, s] = (s, float(level), 0)
        t[0, s + WEAK] = (s + WEAK, level / 3, 0)
    return t


def aimed() -> Transducer:
    """An insult or threat with a target before it, within a few words, weighs more; a threat without weighs nothing."""
    bonus = {THREAT: 2.0, THREAT + WEAK: 0.5, **{s: 0.5 for s in range(INSULT, 9)}, **{s + WEAK: 0.1 for s in range(INSULT, 9)}}
    return _fades(TARGET, lambda s: (s, bonus.get(s, 0.0)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """b reads what a passes on; weights add. States are pairs, numbered in the order they are reached."""
    symbols = sorted({s for _, s in a})
    names, queue, out = {(0, 0): 0}, [(0, 0)], {}
    for pair in queue:
        for s in symbols:
            mid, w1, next_a = a[pair[0], s]
            last, w2, next_b = b[pair[1], mid]
            to = (next_a, next_b)
            if to not in names:
                names[to] = len(names)
                queue.append(to)
            out[names[pair], s] = (last, w1 + w2, names[to])
    return out


def grammar() -> tuple[list[list[float]], list[list[int]]]:
    """The composed machine as tables by state and symbol: weight and next state."""
    t = compose(compose(compose(negation(), reported()), aimed()), insult())
    states = max(k for k, _ in t) + 1
    return [[t[k, s][1] for s in SYMBOLS] for k in range(states)], [[t[k, s][2] for s in SYMBOLS] for k in range(states)]


@dataclass
class Model:
    stems: dict[str, int]  # word beginning to level of insult, 1 to 4
    coefficients: list[float]

    def __getstate__(self):
        return {"stems": self.stems, "coefficients": self.coefficients}


#: Bias, then by feature; used where there is nothing to learn from.
PLAIN = [-3.0, 1.0, 0.5, 1.0, 0.2]


class Reader(dict):
    """Symbols by word; scores clauses and documents."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.lengths = sorted({len(s) for s in model.stems}, reverse=True)
        self.fixed = {w: k for k, words in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (TARGET, TARGETS)) for w in words}
        self.fixed |= {w: INSULT + 2 for w in INSULTS} | {c: END_CLAUSE for c in ".!?;\n"}
        self.weight, self.next = grammar()

    def __missing__(self, word: str) -> int:
        symbol = self.fixed.get(word, OTHER)
        level = max((self.model.stems.get(word[:n], 0) for n in self.lengths if len(word) >= n), default=0)
        symbol = max(symbol, INSULT + level - 1) if level else symbol
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = symbol
        return symbol

    def clauses(self, text: str | None) -> tuple[list[float], int]:
        """Scores of the matched clauses, and the number of words."""
        symbols = list(map(self.__getitem__, TOKEN.findall((text or "").lower())))
        found: list[float] = []
        if symbols and max(symbols) >= THREAT:
            state, total = 0, 0.0
            for s in symbols:
                if s == END_CLAUSE:
                    if total:
                        found.append(total)
                    state, total = 0, 0.0
                else:
                    total += self.weight[state][s]
                    state = self.next[state][s]
            if total:
                found.append(total)
        return found, len(symbols)

    def features(self, text: str | None) -> list[float]:
        found, words = self.clauses(text)
        total = sum(found)
        return [1.0, math.log1p(total), math.log1p(100 * total / max(20, words)), math.log1p(len(found)), max(found, default=0.0)]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.features(text), self.model.coefficients, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels may not be learned from; false for a null id, whose labels teach nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """toxic, text: the labelled documents to learn from. Their ids, at most TRAIN_TOXIC + TRAIN_CLEAN, pass through
    the driver and are broadcast, so that no text is shuffled."""
    usable = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda toxic, n: one.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, TRAIN_TOXIC).unionByName(first(0, TRAIN_CLEAN)).collect()
    ids = docs.sparkSession.createDataFrame([(r.doc_id, int(r.toxic)) for r in chosen], "_id long, toxic int")
    rows = docs.select(docs[id_col], docs[text_col].alias("text"))
    return rows.join(F.broadcast(ids), rows[id_col] == ids["_id"]).select("toxic", "text")


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts of each batch a stem stands. A stem that is clean here may be toxic elsewhere, so
    all are counted; a sample, and so the number of stems, is bounded."""
    for batch in batches:
        counts = (Counter(), Counter())
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(TOKEN.findall((text or "").lower()))
            counts[toxic].update({w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n})
        stems = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(stems, pa.string()), pa.array([counts[1][s] for s in stems], pa.int64()), pa.array([counts[0][s] for s in stems], pa.int64())],
            names=["stem", "in_toxic", "in_clean"],
        )


def evidence(t: float, c: float, toxic: float, clean: float) -> float:
    """Log-likelihood ratio of a stem that stands in t of the toxic and c of the clean documents."""

    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    both = min(1 - 1e-12, (t + c) / (toxic + clean))
    return 2 * (part(t, toxic, t / toxic) if t < toxic else 0.0) + 2 * (part(c, clean, c / clean) if 0 < c < clean else 0.0) - 2 * part(t, toxic, both) - 2 * part(c, clean, both)


def choose_stems(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, int]:
    """Stems by level. Of stems that begin each other only the one with the strongest evidence is kept, the longest of equals."""
    scored = []
    for stem, t, c in rows:
        weight = math.log((t + 0.5) / (c + 0.5)) - math.log(toxic / clean)
        g = evidence(t, c, toxic, clean)
        if weight >= MIN_WEIGHT and g >= MIN_EVIDENCE:
            scored.append((-g, -len(stem), stem, weight))
    kept: dict[str, int] = {}
    ends: set[str] = set()  # all beginnings of kept stems
    for _, _, stem, weight in sorted(scored):
        beginnings = {stem[:n] for n in range(1, len(stem) + 1)}
        if stem in ends or any(b in kept for b in beginnings):
            continue
        kept[stem] = 1 + sum(weight >= x for x in LEVELS)
        ends |= beginnings
        if len(kept) >= MOST_STEMS:
            break
    return kept


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.5) -> list[float]:
    """Newton's method with a ridge on all but the bias."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    # Exact copies teach once.
    rows = sample(docs, labels, id_col, text_col).groupBy(F.xxhash64("text").alias("copy")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    rows = rows.select("toxic", "text").persist()
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        rows.unpersist()
        return Model({}, PLAIN)
    sums = rows.mapInArrow(_stem_counts, "stem string, in_toxic long, in_clean long").groupBy("stem").agg(F.sum("in_toxic").alias("t"), F.sum("in_clean").alias("c"))
    # The strongest possible stems only: no more than a bounded number of rows comes to the driver.
    often = sums.where((F.col("t") >= max(MIN_TOXIC, MIN_SHARE * toxic)) & (F.col("t") * clean >= F.col("c") * toxic * math.exp(MIN_WEIGHT)))
    best = often.orderBy(F.desc(F.col("t") - F.col("c") * toxic / clean), "stem").limit(50 * MOST_STEMS).collect()
    stems = choose_stems([(r.stem, r.t, r.c) for r in best], toxic, clean)
    reader_of = Model(stems, PLAIN)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(reader_of)
        for batch in batches:
            x = [reader.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    found = rows.mapInArrow(features, "toxic int, x array<double>").collect()  # as many rows as the sample
    rows.unpersist()
    x, y = np.array([r.x for r in found]), np.array([r.toxic for r in found], float)
    order = np.lexsort([*x.T, y])  # the sum, and so the last digits, do not depend on the order of rows
    return Model(stems, fit_logistic(x[order], y[order]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col], docs[text_col]).mapInArrow(_scores(model), f"id {kind}, score double")
    return rows.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            scores = pa.array([reader.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["id", "score"])

    return run


def _keep_clean(model: Model, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            yield batch.filter(pa.array([reader.score(t) < CUT for t in batch.column(column).to_pylist()], pa.bool_()))

    return run


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that score below CUT, with all their columns."""
    return docs.mapInArrow(_keep_clean(model, docs.columns.index(text_col)), docs.schema)
