"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, weak insult, threat, target, negation, report, turn, break, other). Transducers rewrite the
symbols of a clause one behind the other: behind a negation, up to a turn (a comma or a word like "but"), offences come out
as negated ones; behind a word of reported speech, up to the clause's end, as reported ones. Machines for insults, threats,
targets and for what was negated or reported read the result. All are composed into one table of states, so a text
takes one step for each word. At the end of each clause its state says what the clause holds, for instance a threat
at a target that is neither negated nor reported. A document's counts of such clauses, weighted, give its score.

Both the lexicon and the weights are learned from labelled rows alone: one part of them gives insult words and word
stems of any language, the other part the weights. At most about ``max_rows`` labelled rows, chosen by a hash, are used;
the lexicon holds every word of them that stands out enough. A feature of which the labels show nothing keeps
its weight of before, so threats count even where no label shows one.

Defined cases: null and empty texts have no clauses and get the score of that. Labels with null marks, and labels of
unknown documents, teach nothing; of repeated labels of a document each counts. Without labels of both kinds in both
parts the seed lexicon and the weights of before are used. Only the named columns are read, whatever others there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_slices, texts_of

#: What words become, and below them what the transducers write for negated and reported offences.
OTHER, INSULT, WEAK, THREAT, TARGET, NEGATION, REPORT, TURN, BREAK = range(9)
NOT_INSULT, NOT_THREAT, SAID_INSULT, SAID_THREAT = range(9, 13)
READ, WRITTEN = 9, 13

#: Seed words of the grammar; learned words join the insults.
SEEDS = {
    INSULT: "idiot idiots moron morons imbecile scum bastard bastards asshole bitch stupid worthless pathetic disgusting loser losers trash garbage vermin filth clown dumb ugly retard".split(),
    THREAT: "kill murder hurt destroy beat shoot stab burn hang punch smash rape attack".split(),
    TARGET: "you your yours yourself u ur he she they them him her his their these those people tu te toi vous du dich dir ihr euch usted ustedes ti".split(),
    NEGATION: "not no never nobody isn aren wasn don doesn didn won without hardly nicht kein keine nie pas jamais ni nunca jamás".split(),
    REPORT: "said says say called calls quoted quote wrote writes reported reportedly alleged allegedly claims claimed according sagte dit dijo".split(),
    TURN: "but however aber mais pero sondern".split(),
}
STEM = 5
TOKEN = re.compile(r"\w+|[,.!?;:\n]")
MIN_DOCS = 6

#: A transducer is its number of states and its moves (state, symbol) to (state, symbol written); what isn't named stays as it is.
Transducer = tuple[int, dict[tuple[int, int], tuple[int, int]]]
NEGATING: Transducer = (2, {(0, NEGATION): (1, NEGATION), (1, TURN): (0, TURN), (1, INSULT): (1, NOT_INSULT), (1, WEAK): (1, NOT_INSULT), (1, THREAT): (1, NOT_THREAT)})
REPORTING: Transducer = (2, {(0, REPORT): (1, REPORT), (1, INSULT): (1, SAID_INSULT), (1, WEAK): (1, SAID_INSULT), (1, THREAT): (1, SAID_THREAT)})
#: Machines that read what the transducers write: insult (none, weak, strong), threat, target, negated and reported offences.
INSULTING: Transducer = (3, {(0, WEAK): (1, WEAK), (0, INSULT): (2, INSULT), (1, INSULT): (2, INSULT)})
MACHINES = [NEGATING, REPORTING, INSULTING] + [(2, {(0, symbol): (1, symbol)}) for symbol in (THREAT, TARGET, NOT_INSULT, NOT_THREAT, SAID_INSULT, SAID_THREAT)]


def compose(machines: list[Transducer]) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """``table[state][symbol]`` and the states of the cascade: each machine reads what the one before it wrote. 0 is the start."""
    start = (0,) * len(machines)
    number, states, table = {start: 0}, [start], []
    for state in states:  # grows while it runs
        row = []
        for symbol in range(READ):
            after = []
            for at, (_, moves) in zip(state, machines, strict=True):
                to, symbol = moves.get((at, symbol), (at, symbol))
                after.append(to)
            after = tuple(after)
            if after not in number:
                number[after] = len(states)
                states.append(after)
            row.append(number[after])
        table.append(row)
    return table, states


TABLE, STATES = compose(MACHINES)
FEATURES = ("strong", "weak", "strong_target", "weak_target", "threat", "threat_target", "negated_insult", "negated_threat", "reported_insult", "reported_threat")
#: The first features are direct offences, whose weights are never below 0.
DIRECT = 6


def clause_features(state: tuple[int, ...]) -> list[int]:
    _, _, insult, threat, target, not_insult, not_threat, said_insult, said_threat = state
    return [int(insult == 2), int(insult == 1), int(insult == 2 and target), int(insult == 1 and target), threat, int(threat and target), not_insult, not_threat, said_insult, said_threat]


OUTPUT = np.array([clause_features(s) for s in STATES], np.int64)


@dataclass(frozen=True)
class Grammar:
    words: dict[str, int]
    stems: dict[str, int]
    weights: tuple[float, ...]
    bias: float


def seed_words() -> dict[str, int]:
    return {w: symbol for symbol, words in SEEDS.items() for w in words} | dict.fromkeys(".!?;:\n", BREAK) | {",": TURN}


DEFAULT = Grammar(seed_words(), {}, (2.5, 1.0, 0.5, 0.5, 0.5, 2.5, 0.2, 0.1, 0.2, 0.2), -2.0)


def symbols(text: str, grammar: Grammar) -> list[int]:
    words, stems = grammar.words, grammar.stems
    return [words.get(w) or stems.get(w[:STEM], 0) for w in TOKEN.findall(text.lower())]


def document_features(text: str, grammar: Grammar) -> np.ndarray:
    """How many clauses show each feature."""
    seen: dict[int, int] = {}
    state = 0
    for s in symbols(text, grammar):
        if s == BREAK:
            if state:
                seen[state] = seen.get(state, 0) + 1
                state = 0
        elif s:
            state = TABLE[state][s]
    seen[state] = seen.get(state, 0) + 1
    return np.array(list(seen.values()), np.int64) @ OUTPUT[list(seen)]


def score(features: np.ndarray, grammar: Grammar) -> np.ndarray:
    x = np.log1p(features) @ np.array(grammar.weights) + grammar.bias
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")), F.lit(5))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000) -> Grammar:
    """A grammar from the labelled rows outside the held-out fold; ``labels`` has the id and the mark (1 toxic, 0 not)."""
    marks = labels.select(labels[id_col].alias("__id"), labels[label_col].cast("int").alias("toxic")).where("toxic is not null and __id is not null").withColumn("fold", fold("__id")).where("fold != 0")
    n = marks.count()
    if not n:
        return DEFAULT
    # a share of the rows by hash, so that about max_rows are taken whatever the size
    share = min(1.0, max_rows / n)
    picked = marks.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 53)).cast("double") < share * (1 << 53))
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("text")).join(picked, "__id").select("text", "toxic", "fold")
    # words and stems by the number of documents that hold them, in folds 1 to 3
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    stems = F.array_distinct(F.transform(F.filter(tokens, lambda w: F.length(w) >= STEM), lambda w: F.concat(F.lit("^"), F.substring(w, 1, STEM))))
    taught = rows.where("fold != 4")
    totals = taught.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, n = int(totals["bad"] or 0), int(totals["n"])
    if not bad or bad == n:
        return DEFAULT
    counts = taught.select("toxic", F.explode(F.concat(tokens, stems)).alias("w")).groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    # rates of holding the word among toxic and other documents, smoothed
    ratio = ((F.col("a") + 0.2) / (bad + 1.0)) / ((F.col("b") + 0.2) / (n - bad + 1.0))
    best = counts.where(F.col("a") >= MIN_DOCS).withColumn("ratio", ratio).where("ratio >= 12").orderBy(F.desc("a"), "w").collect()  # some words of the taught rows, whose number is bounded
    words, found = seed_words(), {}
    for r in best:
        if r["w"].startswith("^"):
            found[r["w"][1:]] = WEAK
        elif r["w"] not in words:
            words[r["w"]] = INSULT if r["ratio"] >= 60 else WEAK
    grammar = Grammar(words, found, DEFAULT.weights, DEFAULT.bias)
    # weights from fold 4, which the lexicon has not seen
    sample = featured(rows.where("fold = 4").select("text", "toxic"), grammar).toPandas()
    if sample.toxic.nunique() < 2:
        return grammar
    weights, bias = fit(np.array(sample.features.tolist(), float), sample.toxic.to_numpy(float))
    return Grammar(words, found, tuple(weights), bias)


def featured(rows: DataFrame, grammar: Grammar) -> DataFrame:
    arrow = pa.schema([("toxic", pa.int32()), ("features", pa.list_(pa.int64()))])

    def run(part):
        return {"toxic": part.column(1), "features": [document_features(t, grammar).tolist() for t in texts_of(part, 0)]}

    return map_slices(rows, run, "toxic int, features array<long>", arrow, 0)


def fit(counts: np.ndarray, marks: np.ndarray, ridge: float = 0.02, rounds: int = 3000) -> tuple[list[float], float]:
    """Logistic regression by gradient steps, drawn towards the weights of before; those of direct offences stay at 0 or above."""
    x = np.log1p(counts)
    w, b = np.array(DEFAULT.weights), DEFAULT.bias
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = x.T @ (p - marks) / len(marks) + ridge * (w - np.array(DEFAULT.weights)) / len(marks) ** 0.5
        w = w - 0.5 * g
        w[:DIRECT] = np.maximum(w[:DIRECT], 0)
        b -= 0.5 * float((p - marks).mean())
    return w.tolist(), float(b)


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the counts of clauses by feature."""
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("clauses", pa.list_(pa.int64()))])

    def run(part):
        found = np.array([document_features(t, grammar) for t in texts_of(part, 1)]).reshape(-1, len(FEATURES))
        values = score(found, grammar)
        return {"doc_id": part.column(0), "held_out": part.column(2), "score": values, "predicted": (values >= 0.5).astype(np.int32), "clauses": found.tolist()}

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), (fold(id_col) == 0).alias("held_out"))
    return map_slices(rows, run, "doc_id long, held_out boolean, score double, predicted int, clauses array<long>", arrow, 1)
