"""Toxicity classifier, regularised by counterfactuals.

Features of a text are its distinct words and their character 4-grams with word ends, hashed into FEATURES numbers. Spark counts,
over all training rows, in how many toxic and other texts each number occurs; every number that tells the two apart is kept. A
logistic model is fitted on these. In every training text with identity terms, these are swapped for others; the squared change of the score is
penalised, and so are score differences between neutral sentences that differ by the term only. So a group's name cannot carry
weight, and its neutral mention is no false positive.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, texts
from ledgerlens.llm.tokens import _Memo

#: The classifier is fitted on the training rows with the smallest hash of doc_id, at most so many. Feature statistics use all rows.
MAX_TRAINING_ROWS = 40_000
#: Features are hashed into so many numbers, which bounds the model; none that qualifies is left out.
FEATURES = 1 << 22
#: Chunks of text a task remembers, in each of two generations.
MEMO = 200_000
MIN_TOXIC_TEXTS = 4
#: A feature is kept when this many times as frequent in toxic texts as in others (smoothed), or as rare.
MIN_RATIO = 4.0
COUNTERFACTUALS = 3
PENALTY, RIDGE, STEPS = 20.0, 2e-4, 400
THRESHOLD = 0.3
WORD = re.compile(r"\w+")

#: Identity terms in the languages of the corpus.
IDENTITY = frozenset(
    "woman women man men female male girl girls boy boys transgender trans nonbinary gay lesbian bisexual queer straight heterosexual homosexual "
    "black white asian african american european hispanic latino latina arab indian chinese japanese mexican immigrant immigrants refugee refugees "
    "muslim muslims christian christians jewish jew jews hindu buddhist catholic protestant atheist old young elderly blind deaf disabled "
    "frau frauen mann männer mädchen junge schwul lesbisch schwarz weiß muslimisch jüdisch christlich behindert ausländer flüchtling flüchtlinge "
    "femme femmes homme hommes fille garçon noir blanc arabe juif juive musulman musulmane chrétien chrétienne handicapé immigré immigrés réfugié "
    "mujer mujeres hombre hombres niña niño negro blanco árabe judío judía musulmán musulmana cristiano cristiana discapacitado inmigrante refugiado".split()
)
#: Neutral sentences.
NEUTRAL = ("i am {}", "my friend is {}", "the {} people live here", "we met a {} neighbour today", "ein text über {}", "un texte sur {}", "un texto sobre {}")


def held_out(doc_id) -> bool:
    """Whether crc32(doc_id as text) mod 4 is 2; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def word_features(word: str) -> list[str]:
    """The word with its ends marked, and its character 4-grams with these marks."""
    marked = f"^{word}$"
    return [marked, *{marked[k : k + 4] for k in range(len(marked) - 3)} - {marked}]


def chunks(text: str) -> set[str]:
    return set(text.lower().split())


@functools.lru_cache(maxsize=200_000)
def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


def hashed(chunk: str) -> np.ndarray:
    return np.array(sorted({_hash(f) for word in WORD.findall(chunk) for f in word_features(word)}), np.int64)


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, n_toxic, n_other over all rows of (text, toxic); combined in tasks, then by a sum."""

    def count(batches):
        import pyarrow as pa

        memo = _Memo(hashed, MEMO)
        for batch in batches:
            found: dict[int, list[np.ndarray]] = {0: [], 1: []}
            size = 0

            def counted():
                parts = []
                for toxic in (0, 1):
                    if found[toxic]:
                        keys, n = np.unique(np.concatenate(found[toxic]), return_counts=True)
                        zero = np.zeros(len(n), np.int64)
                        parts.append(pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n if toxic else zero), pa.array(zero if toxic else n)], names=["feature", "n_toxic", "n_other"]))
                        found[toxic].clear()
                return parts

            for text, toxic in texts([batch], ["text", "toxic"], 200):
                own = [memo[c] for c in chunks(text or "")]
                if own:
                    keys = np.unique(np.concatenate(own))
                    found[1 if toxic == 1 else 0].append(keys)
                    size += len(keys)
                    if size > 4_000_000:
                        yield from counted()
                        size = 0
            yield from counted()

    parts = rows.select("text", "toxic").mapInArrow(count, "feature long, n_toxic long, n_other long")
    return parts.groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))


def choose_features(rows: DataFrame) -> list[int]:
    """The numbers of features that tell toxic texts from others, by a signed two-sample statistic over all rows; ascending."""
    sizes = rows.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("toxic"), F.sum((F.col("toxic") == 0).cast("long")).alias("other")).first()
    toxic, other = float(sizes["toxic"] or 0), float(sizes["other"] or 0)
    if not toxic or not other:
        return []
    p, q = (F.col("n_toxic") + 0.5) / (toxic + 1), (F.col("n_other") + 0.5) / (other + 1)
    both = (F.col("n_toxic") + F.col("n_other") + 1.0) / (toxic + other + 2)
    z = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / toxic + 1 / other))
    telling = (F.col("n_toxic") >= MIN_TOXIC_TEXTS) & (p >= MIN_RATIO * q) | (F.col("n_other") >= 50) & (q >= MIN_RATIO * p)
    return sorted(row["feature"] for row in feature_counts(rows).filter(telling & (z >= 3.0)).select("feature").collect())  # FEATURES at most


class Vocabulary:
    """Chosen features of a text, through a memo of its chunks."""

    def __init__(self, features: list[int]):
        self.number = {feature: k for k, feature in enumerate(features)}
        self.memo = _Memo(self._chunk, MEMO)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        get = self.number.get
        known = {get(_hash(f)) for word in WORD.findall(chunk) for f in word_features(word)}
        known.discard(None)
        return tuple(known) if known else ()

    def of(self, own_chunks) -> set[int]:
        return set().union(*map(self.memo.__getitem__, own_chunks))


def counterfactuals(own_chunks: set[str], seed: int) -> list[set[str]]:
    """The chunks with every identity term swapped for another, COUNTERFACTUALS times; none without a term."""
    terms = sorted(IDENTITY)
    plain = {chunk: chunk.strip(".,;:!?\"'()") for chunk in own_chunks}
    found = sorted(chunk for chunk, word in plain.items() if word in IDENTITY)
    out = []
    for turn in range(COUNTERFACTUALS if found else 0):
        other = {chunk: terms[zlib.crc32(f"{seed} {turn} {plain[chunk]}".encode()) % len(terms)] for chunk in found}
        out.append({other.get(chunk, chunk) for chunk in own_chunks})
    return out


class Model:
    def __init__(self, features: list[int], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias
        self.vocabulary = None

    def __getstate__(self):
        return {"features": self.features, "weights": self.weights, "bias": self.bias, "vocabulary": None}

    def score(self, text: str | None) -> float:
        """0 to 1; a null or empty text has no features and gets the bias alone."""
        if self.vocabulary is None:
            self.vocabulary = Vocabulary(self.features)
        numbers = self.vocabulary.of(chunks(text or ""))
        return float(_sigmoid(self.bias + self.weights[sorted(numbers)].sum() if numbers else self.bias))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sparse(sets: list) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return rows, np.fromiter((k for s in sets for k in sorted(s)), np.int64, len(rows))


def fit(features: list[int], sets: list, toxic: np.ndarray, pairs: list[tuple[int, set]]) -> Model:
    """Logistic loss, ridge and, for each pair (text number, features of its counterfactual), PENALTY times the squared change
    of the linear score, averaged. Neutral sentences add pairs of their own. Adam on full batches, the same on every machine."""
    size = len(features)
    weights, bias = np.zeros(size), float(np.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1)))
    rows, columns = _sparse(sets)
    vocabulary = Vocabulary(features)
    changes = [(set(sets[number]) - set(other), set(other) - set(sets[number])) for number, other in pairs]
    for sentence in NEUTRAL:
        empty = vocabulary.of(chunks(sentence.format("")))
        for term in sorted(IDENTITY):
            changes.append((vocabulary.of(chunks(sentence.format(term))) - empty, set()))
    changes = [c for c in changes if c[0] or c[1]]
    minus_rows, minus = _sparse([c[0] for c in changes])
    plus_rows, plus = _sparse([c[1] for c in changes])
    momentum, speed = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        linear = bias + np.bincount(rows, weights[columns], len(sets))
        error = (_sigmoid(linear) - toxic) / len(sets)
        gradient = np.append(np.bincount(columns, error[rows], size) + RIDGE * weights, error.sum())
        if changes:
            change = np.bincount(plus_rows, weights[plus], len(changes)) - np.bincount(minus_rows, weights[minus], len(changes))
            pull = 2 * PENALTY * change / len(changes)
            gradient[:-1] += np.bincount(plus, pull[plus_rows], size) - np.bincount(minus, pull[minus_rows], size)
        momentum = 0.9 * momentum + 0.1 * gradient
        speed = 0.999 * speed + 0.001 * gradient**2
        move = 0.1 * (momentum / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return Model(features, weights, bias)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and a place (h, doc_id) of the documents to learn from, as a table: all that follows reads these rows only."""
    # crc32 of Spark is that of the same bytes.
    usable = labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    # A table of its own, so that Spark knows its size before it joins and moves no text where the labels are few.
    known = materialize(usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    return materialize(rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic"), "labelled")


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the smallest hashes, about most of them (equal doc_ids stay together), found on narrow rows."""
    if rows.count() <= most:
        return rows
    last = rows.select("h", "doc_id").orderBy("h", "doc_id").limit(most).agg(F.max(F.struct("h", "doc_id")).alias("last")).first()["last"]
    return rows.filter((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("doc_id") <= last["doc_id"]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labelled documents that are not held out. labels: doc_id, toxic; rows with a null in either, or with another
    value than 0 and 1, are not used; a document with several labels is toxic if one says so. Without rows of both kinds every
    score is 0.5 or less: the share of toxic rows."""
    rows = labelled(docs, labels)
    features = choose_features(rows)
    sample = sampled(rows, MAX_TRAINING_ROWS)

    def vectors(batches):
        import pyarrow as pa

        vocabulary = Vocabulary(features)
        for batch in batches:
            out = {"seed": [], "toxic": [], "own": [], "swapped": []}
            for text, toxic in texts([batch], ["text", "toxic"], 200):
                own = chunks(text or "")
                seed = zlib.crc32((text or "").encode())
                out["seed"].append(seed)
                out["toxic"].append(toxic)
                out["own"].append(sorted(vocabulary.of(own)))
                out["swapped"].append([sorted(vocabulary.of(other)) for other in counterfactuals(own, seed)])
            yield pa.RecordBatch.from_pydict(out, schema=OUT)

    import pyarrow as pa

    NUMBERS = pa.list_(pa.int32())
    OUT = pa.schema([("seed", pa.int64()), ("toxic", pa.int32()), ("own", NUMBERS), ("swapped", pa.list_(NUMBERS))])
    made = sample.select("text", "toxic").mapInArrow(vectors, "seed long, toxic int, own array<int>, swapped array<array<int>>")
    # MAX_TRAINING_ROWS short rows of feature numbers, in an order that the texts give.
    table = made.toArrow().sort_by([("seed", "ascending"), ("toxic", "ascending")])
    sets, toxic = table.column("own").to_pylist(), np.array(table.column("toxic").to_pylist(), float)
    pairs = [(number, other) for number, swapped in enumerate(table.column("swapped").to_pylist()) for other in swapped]
    return fit(features, sets, toxic, pairs) if len(sets) else Model([], np.zeros(0), 0.0)


def _scored(docs: DataFrame, model: Model):
    """The score as a column over text. The model has FEATURES numbers at most, which bounds what is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        return pd.Series([shared.value.score(t) for t in text], dtype="float64")

    return scored(F.col("text").cast("string"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, repeated rows and null or empty texts included. Other columns of
    docs are not returned, whatever their names."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    found = docs.select("doc_id", out.alias("held_out"), _scored(docs, model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns as they are, also columns called score or predicted."""
    return docs.filter(_scored(docs, model) < THRESHOLD)
