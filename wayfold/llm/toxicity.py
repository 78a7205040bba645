"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, other. Transducers for negation, reported speech and targets
rewrite the symbols in turn; composed, they are one deterministic machine that reads a clause once and says which pattern
the clause matches. A text's score weighs its clauses by pattern. Insults are learned from labelled texts, as words and as
word beginnings; so are the weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.store import free_names, written

#: Labelled texts, about, that the lexicon and the weights are learned from, and texts whose labels are never looked at.
TRAINING_ROWS = 20_000
HELD_OUT_FOLDS = 5
#: Toxic texts of the sample that a word or beginning needs at least, its log odds, and these less one standard error.
#: None depends on the size of the sample.
LEAST_TEXTS, LEAST_ODDS, SURE_ODDS = 5, 3.5, 2.5
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Words up to which a negation reaches.
NEGATION_REACH = 3
MEMO = 1 << 17
#: What a threat weighs; insults weigh their log odds.
THREAT_WEIGHT = 1.0

# Function words and threats in English, German, French and Spanish.
THREATS = """
kill murder stab shoot strangle beat hurt destroy lynch
töten umbringen erschießen erstechen erwürgen verprügeln vernichten
tuer assassiner étrangler poignarder frapper détruire
matar asesinar apuñalar estrangular golpear destruir
""".split()
TARGETS = """
you your yours yourself they them their he him she her
du dich dir dein deine ihr euch eure sie ihnen
tu te toi ton ta tes vous votre vos ils elles eux
tú ti tus usted ustedes ellos ellas vosotros vuestro
""".split()
NEGATIONS = """
not no never nobody nothing without cannot don't isn't wasn't aren't won't
nicht kein keine keinen nie niemals ohne
pas jamais aucun aucune rien sans
nunca jamás ningún ninguna nada sin
""".split()
REPORTS = """
said says told claimed claims reported quoted wrote alleged according
sagte sagt behauptete behauptet schrieb laut zitierte
dit disait affirme affirmait selon écrit
dijo dice afirmó según escribió
""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, CUT = "oITYNR|"
NEGATED, REPORTED = "n", "q"
PATTERNS = ["insult", "insult at target", "threat", "threat at target", "both", "negated or reported"]

PARTS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.,;:!?()\"\n]")


class Transducer:
    """Deterministic: moves maps (state, symbol) to (state, output); symbols it lacks are kept. final names end states."""

    def __init__(self, start, moves: dict, final: dict | None = None):
        self.start, self.moves, self.final = start, moves, final or {}

    def step(self, state, symbol):
        return self.moves.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The machine that runs second on what first puts out, over all states that the symbols reach."""
    start = (first.start, second.start)
    moves, todo, seen = {}, [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in symbols:
            a2, middle = first.step(a, symbol)
            b2, out = second.step(b, middle)
            moves[state, symbol] = ((a2, b2), out)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(start, moves, {s: second.final[s[1]] for s in seen if s[1] in second.final})


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """Insults and threats within so many words after a negation become negated ones."""
    moves = {}
    for left in range(reach + 1):
        for symbol in (OTHER, TARGET, REPORT):
            moves[left, symbol] = (max(0, left - 1), symbol)
        for symbol in (INSULT, THREAT):
            moves[left, symbol] = (max(0, left - 1), NEGATED if left else symbol)
        moves[left, NEGATION] = (reach, OTHER)
    return Transducer(0, moves)


def reported_speech() -> Transducer:
    """What follows a verb of saying in a clause is somebody else's."""
    moves = {(0, REPORT): (1, OTHER), (1, REPORT): (1, OTHER)}
    moves |= {(1, symbol): (1, REPORTED) for symbol in (INSULT, THREAT)}
    return Transducer(0, moves)


def targets() -> Transducer:
    """Remembers whom and what a clause names; its end state is the clause's pattern."""
    moves, final = {}, {}
    flags = [(t, i, h, w) for t in (0, 1) for i in (0, 1) for h in (0, 1) for w in (0, 1)]
    for t, i, h, w in flags:
        state = (t, i, h, w)
        moves[state, TARGET] = ((1, i, h, w), OTHER)
        moves[state, INSULT] = ((t, 1, h, w), OTHER)
        moves[state, THREAT] = ((t, i, 1, w), OTHER)
        moves[state, NEGATED] = moves[state, REPORTED] = ((t, i, h, 1), OTHER)
        if i and h:
            final[state] = "both"
        elif i or h:
            final[state] = ("insult" if i else "threat") + (" at target" if t else "")
        elif w:
            final[state] = "negated or reported"
    return Transducer((0, 0, 0, 0), moves, final)


def grammar() -> Transducer:
    symbols = "".join([OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT])
    return compose(compose(negation(), reported_speech(), symbols), targets(), symbols)


class Lexicon(dict):
    """Symbol of each word, remembered for as many words as MEMO. odds: log odds of learned words, and of beginnings as "abc*"."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds
        for symbol, listed in ((TARGET, TARGETS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT, THREATS)):
            self.update(dict.fromkeys(listed, symbol))
        self.update({word: INSULT for word in odds if not word.endswith("*")})
        self.update(dict.fromkeys(".,;:!?()\"\n", CUT))

    def weight(self, word: str) -> float:
        """The largest log odds of the word and its beginnings; 0 for an unknown word."""
        return max([self.odds.get(word, 0.0), *(self.odds.get(f"{word[:k]}*", 0.0) for k in BEGINNINGS if len(word) > k)])

    def __missing__(self, word: str) -> str:
        symbol = INSULT if self.weight(word) else OTHER
        if len(self) < MEMO:
            self[word] = symbol
        return symbol


def pattern_weights(text: str, lexicon: Lexicon, machine: Transducer) -> list[float]:
    """For each pattern, the weights of the insults and threats in the clauses that match it."""
    found = dict.fromkeys(PATTERNS, 0.0)
    words = PARTS.findall(text.lower())
    symbols = "".join(map(lexicon.__getitem__, words))
    if INSULT in symbols or THREAT in symbols:
        at = 0
        for clause in symbols.split(CUT):
            if INSULT in clause or THREAT in clause:
                state, weight = machine.start, 0.0
                for k, symbol in enumerate(clause):
                    state = machine.step(state, symbol)[0]
                    if symbol == INSULT:
                        weight += lexicon.weight(words[at + k])
                    elif symbol == THREAT:
                        weight += THREAT_WEIGHT
                found[machine.final[state]] += weight
            at += len(clause) + 1
    return list(found.values())


def features(weights: np.ndarray) -> np.ndarray:
    """Whether a pattern is matched, and the logarithm of how much."""
    return np.hstack([(weights > 0).astype(float), np.log1p(weights)])


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned from; a row without an id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_FOLDS)) == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """(text, toxic) of about so many labelled texts outside the held-out fold, chosen by hash; equal texts once."""
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    usable = usable.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("toxic"))
    share = min(1.0, rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample is bounded by rows, whatever the size of the tables.
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    return written(found.where("text IS NOT NULL").select("text", "toxic").dropDuplicates(["text"]), "training")


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Log odds of the words, and of the word beginnings ("abc*"), that toxic texts of the sample have much more often than others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {p for p in PARTS.findall(text.lower()) if p not in '.,;:!?()"\n'}
                found = words | {f"{w[:k]}*" for w in words for k in BEGINNINGS if len(w) > k}
                (toxic if label else clean).update(found)
        names = list(toxic.keys() | clean.keys())
        columns = [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "clean"])

    sizes = texts.agg(F.sum((F.col("toxic") > 0).cast("int")).alias("t"), F.sum((F.col("toxic") <= 0).cast("int")).alias("c")).first()
    n_toxic, n_clean = sizes["t"] or 0, sizes["c"] or 0
    counts = texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "feature string, toxic long, clean long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    sure = (F.col("toxic") >= LEAST_TEXTS) & (odds >= LEAST_ODDS) & (odds - error >= SURE_ODDS)
    rows = counts.select("feature", "toxic", odds.alias("odds"), sure.alias("sure")).where("sure")
    return {r["feature"]: r["odds"] for r in rows.collect()}


def count_patterns(docs: DataFrame, lexicon: dict[str, float], *, keep: list[str], text: str) -> DataFrame:
    """The columns keep with an array of pattern_weights; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(keep)] + [F.col(text).alias("text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, machine = Lexicon(shared.value), grammar()
        for batch in batches:
            counts = [pattern_weights(t or "", known, machine) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(counts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "patterns"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    counted = rows.mapInArrow(run, ", ".join([*kinds, "patterns array<double>"]))
    return counted.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "patterns")


def fit(counts: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the patterns and a constant: logistic regression by Newton steps, pulled towards zero."""
    x = np.hstack([features(counts), np.ones((len(counts), 1))])
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (labels - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAINING_ROWS) -> dict:
    """Lexicon and weights from a bounded sample of labelled texts. Without usable labels nothing is toxic."""
    texts = training_texts(docs, labels, doc_id=doc_id, text=text, label=label, rows=rows)
    lexicon = learn_lexicon(texts)
    sample = count_patterns(texts, lexicon, keep=["toxic"], text="text").collect()
    if not sample:
        return {"lexicon": lexicon, "weights": [0.0] * 2 * len(PATTERNS) + [-5.0]}
    counts = np.array([r["patterns"] for r in sample])
    weights = fit(counts, np.array([float(r["toxic"] > 0) for r in sample]))
    return {"lexicon": lexicon, "weights": weights.tolist()}


def score(docs: DataFrame, model: dict, *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep with patterns (pattern_weights), score (0 to 1) and predicted (1 from 0.5 on).

    Nothing but the text goes into a score. Null, empty and wordless texts match no pattern and have the lowest score.
    The three come last; one whose name keep has already gets underscores at its end, and keep's column stays as it is.
    """
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    counted = count_patterns(inner, model["lexicon"], keep=inner.columns[:-1], text="_text")
    linear = F.lit(float(model["weights"][-1]))
    present, amount = np.split(np.array(model["weights"][:-1]), 2)
    for k in range(len(PATTERNS)):
        count = F.get("patterns", F.lit(k))
        linear = linear + F.when(count > 0, float(present[k])).otherwise(0.0) + F.log1p(count) * float(amount[k])
    value = 1 / (1 + F.exp(-linear))
    scored = counted.withColumn("score", value).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return scored.toDF(*keep, *free_names(["patterns", "score", "predicted"], keep))
