"""Hierarchical language identification with linear support vector machines.

A text's features are the shares of its byte bigrams and trigrams (A-Z as a-z, everything else in
ASCII that is not a letter as a space) in BUCKETS hashed buckets. The family of the language is
predicted first, one machine against the rest for each family; inside the family, one machine for
each pair of its languages votes. As features are shares, a text's margin is the mean of one weight
for each of its n-grams, which numpy gathers for whole runs of texts.

The machines are fitted on a bounded sample: at most SAMPLE rows over all languages and PER_LANGUAGE
of one, the rows of the smallest text hashes, from rows with a language that are not held out
(crc32 of doc_id as text, modulo 5, is 0). Of more than MAX_LANGUAGES values of ``lang`` those with the
most distinct texts are learned. Everything else covers all rows.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; a null doc_id is
neither learned from nor held out; without a labelled row every text is ``und``; equal texts have
equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASH_RUN_BYTES, byte_sizes, column, documents, filled, prepare, runs

QUERY = "op3_language_id"
BUCKETS = 1 << 12
SAMPLE, PER_LANGUAGE, MAX_LANGUAGES = 4000, 600, 200
#: A score below which a corpus should not trust a prediction, for ``keep_identified``.
LEAST_SCORE = 0.4
FOLDS = 5
UNKNOWN = "und"
#: Features are scaled by this before fitting; margins are turned to probabilities by SLOPE.
SCALE, COST, ROUNDS, SLOPE = 40.0, 1.0, 25, 2.0

#: Families of languages by ISO 639-1 code; a language that is not here is a family of its own. Fixed values.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi ur bn pa gu mr ne si",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
LETTER = regex.compile(r"\p{L}")
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32
FOLD[[k for k in range(128) if not chr(k).isalpha()]] = 32


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the bigram and the trigram at each byte [2, bytes], and the offsets of texts; spaces follow a text."""
    data = ("  ".join(texts) + "  ").encode()
    b = FOLD[np.frombuffer(data, np.uint8)]
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:] + np.uint32(1)
    spread = lambda x: (x * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    sizes = np.array([len(t.encode()) for t in texts])
    begins = np.cumsum(sizes + 2) - sizes - 2
    return np.stack([spread(two)[: len(three)], spread(three)]), np.stack([begins, begins + sizes])


def shares(text: str) -> np.ndarray:
    """The feature vector of a text; its sum is 1."""
    buckets, at = grams([text])
    own = buckets[:, at[0, 0] : at[1, 0]].reshape(-1)
    return (np.bincount(own, minlength=BUCKETS) / max(1, len(own))).astype(np.float32)


def fit_machine(x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear SVM on some rows of x, with squared hinge loss, classes weighted alike, by dual coordinate descent; the last one is the bias."""
    cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * COST
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(y))
    slack = 1 / (2 * cost)
    size = np.einsum("ij,ij->i", x, x)[rows] * SCALE**2 + 1 + slack
    order = np.random.default_rng(0)
    for _ in range(ROUNDS):
        moved = 0.0
        for k in order.permutation(len(y)).tolist():
            own = x[rows[k]]
            gradient = y[k] * (SCALE * (own @ w) + bias) - 1 + slack[k] * alpha[k]
            new = max(0.0, alpha[k] - gradient / size[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                moved = max(moved, abs(step))
                w += step * SCALE * own
                bias += step
                alpha[k] = new
        if moved < 1e-3:
            break
    return np.append(w * SCALE, bias)


class Model:
    """Families, their languages, and the machines; columns of weights are in the order of machines."""

    def __init__(self, labels: list[str], x: np.ndarray):
        self.languages = sorted(set(labels))
        self.families = {}
        for code in self.languages:
            self.families.setdefault(FAMILY_OF.get(code, code), []).append(code)
        self.names = sorted(self.families)
        of = np.array(labels)
        family = np.array([FAMILY_OF.get(c, c) for c in labels])
        machines = [fit_machine(x, np.arange(len(x)), np.where(family == f, 1.0, -1.0)) for f in self.names] if len(self.names) > 1 else []
        self.pairs = [(f, a, b) for f in self.names for a, b in combinations(self.families[f], 2)]
        for _, a, b in self.pairs:
            rows = np.flatnonzero((of == a) | (of == b))
            machines.append(fit_machine(x, rows, np.where(of[rows] == a, 1.0, -1.0)))
        table = np.array(machines, np.float32).reshape(-1, BUCKETS + 1)
        self.weights, self.bias = np.ascontiguousarray(table[:, :-1].T), table[:, -1].astype(np.float64)

    def margins(self, texts: list[str]) -> np.ndarray:
        """Margins [text, machine]."""
        buckets, (begins, ends) = grams(texts)
        out = np.zeros((len(texts), self.weights.shape[1]))
        for k in range(self.weights.shape[1]):
            column = np.ascontiguousarray(self.weights[:, k])
            sums = np.concatenate([[0.0], np.cumsum(column[buckets[0]] + column[buckets[1]], dtype=np.float64)])
            out[:, k] = (sums[ends] - sums[begins]) / np.maximum(1, 2 * (ends - begins)) + self.bias[k]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; equal texts get equal values, whatever is next to them."""
        chance = 1 / (1 + np.exp(-SLOPE * np.round(self.margins(texts), 6)))
        n, at = len(self.names), len(self.names) if len(self.names) > 1 else 0
        family = np.argmax(chance[:, :n], 1) if at else np.zeros(len(texts), int)
        score = chance[np.arange(len(texts)), family] if at else np.ones(len(texts))
        found = [self.families[self.names[f]][0] for f in family]
        for f, name in enumerate(self.names):
            inside, codes = np.flatnonzero(family == f), self.families[name]
            if len(codes) < 2 or not len(inside):
                continue
            votes, sure = np.zeros((len(inside), len(codes))), np.zeros((len(inside), len(codes)))
            for k, (g, a, b) in enumerate(self.pairs):
                if g == name:
                    p = chance[inside, at + k]
                    i, j = codes.index(a), codes.index(b)
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    sure[:, i] += p / (len(codes) - 1)
                    sure[:, j] += (1 - p) / (len(codes) - 1)
            best = np.argmax(votes + sure / 2, 1)
            score[inside] *= sure[np.arange(len(inside)), best]
            for row, k in zip(inside.tolist(), best.tolist(), strict=True):
                found[row] = codes[k]
        return found, score


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame) -> Model | None:
    """The model of a bounded sample of the labelled rows of docs (doc_id, text, lang); None without such rows."""
    prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.length("text") > 0))
    hashed = known.select("lang", F.xxhash64("text").alias("th"))
    ranked_by_texts = hashed.distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in ranked_by_texts.collect()}  # distinct texts, a row for each language
    if not counts:
        return None
    per = max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    # Over twice the wanted share of each language's distinct texts by text hash, equal texts once, then the first ones.
    share = F.create_map(*(x for c, n in counts.items() for x in (F.lit(c), F.lit(min(1 << 20, -(-(2 * per + 64 << 20) // n))))))
    chosen = known.select("lang", "text", F.xxhash64("text").alias("th")).where(F.pmod("th", F.lit(1 << 20)) < F.element_at(share, F.col("lang")))
    from pyspark.sql import Window

    ranked = chosen.dropDuplicates(["lang", "th"]).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("th", F.lit(1 << 20)), "th"))).where(F.col("n") <= per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shares(t).tobytes() for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "lang"), column(batch, "th"), pa.array(x, pa.binary())], ["lang", "th", "x"])

    rows = ranked.select("lang", "th", "text").mapInArrow(run, "lang string, th long, x binary").toArrow().sort_by([("lang", "ascending"), ("th", "ascending")])
    labels, x = rows["lang"].to_pylist(), np.empty((rows.num_rows, BUCKETS), np.float32)
    for k, value in enumerate(rows["x"]):
        x[k] = np.frombuffer(value.as_buffer(), np.float32)
    del rows
    return Model(labels, x) if labels else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """RESULT of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(column(batch, "text"))
            for i, j in runs(byte_sizes(texts), HASH_RUN_BYTES):
                own = texts[i:j].to_pylist()
                named, score = model.predict(own) if model is not None else ([UNKNOWN] * len(own), np.zeros(len(own)))
                lettered = np.array([LETTER.search(t) is not None for t in own], bool)
                named = [x if ok else UNKNOWN for x, ok in zip(named, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[i:j], column(batch, "held_out")[i:j], pa.array(named, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, RESULT)


def keep_identified(docs: DataFrame, model: Model | None, wanted: tuple[str, ...] | None = None, least: float = 0.0, into: str = "lang") -> DataFrame:
    """The rows of docs (text and any columns) whose predicted language is wanted (all that the model knows, if not said) with a score of least or more; into holds it."""
    kinds = [f"`{c}` {'string' if c == into else t}" for c, t in docs.dtypes]
    names = [*docs.columns, *([] if into in docs.columns else [into])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(column(batch, "text"))
            for i, j in runs(byte_sizes(texts), HASH_RUN_BYTES):
                own = texts[i:j].to_pylist()
                named, score = model.predict(own) if model is not None else ([UNKNOWN] * len(own), np.zeros(len(own)))
                kept = [s >= least and (x in wanted if wanted else x != UNKNOWN) and LETTER.search(t) is not None for x, s, t in zip(named, score, own, strict=True)]
                part = batch.slice(i, j - i)
                columns = [pa.array(named, pa.string()) if c == into else column(part, c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, ", ".join(kinds if into in docs.columns else [*kinds, f"`{into}` string"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return identify(docs, fit(docs))
