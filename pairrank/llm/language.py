"""Language identification by hierarchical discrimination.

A document is first given a language family, by one linear support vector machine per
family against the others. Within a family of several languages, one linear machine per
pair of languages then votes. The machines see hashed character n-grams (n = 1 to 3) of the
whole text, and nothing else. Margins become probabilities through a logistic curve fitted
to each machine, and the score is P(family) * P(language | family).

The model is fitted on the driver on at most ``per_language`` documents a language; what
reaches the driver are their n-gram counts, ``FEATURES`` numbers each at most, never texts.
Prediction is one pass over the table in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.functions.text import quoted
from pairrank.llm.expressions import columns_of, pick, unused

UNDETERMINED = "und"
FEATURES = 1 << 14
PER_LANGUAGE = 500
# More languages than this are refused; it bounds the sample and the model.
MAX_LANGUAGES = 200
COST, EPOCHS = 10.0, 20

# Families by ISO 639 code. A language that is not listed is a family by itself.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text, scaled to length one; None if it has no letter.

    Letters are lower-cased, and every run of other characters counts as one space.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    space = codes == 32
    codes = np.concatenate(([32], codes[~(space & np.concatenate(([True], space[:-1])))], [32])).astype(np.uint32)
    total = np.zeros(FEATURES)
    gram = np.zeros(len(codes), np.uint32)
    for n in range(3):
        gram = gram[: len(codes) - n] * np.uint32(0x9E3779B1) + codes[n:] + np.uint32(n)
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA77)
        total += np.bincount(mixed >> np.uint32(18), minlength=FEATURES)
    total = np.sqrt(total)
    return total / np.linalg.norm(total)


class Machine:
    """A linear support vector machine with a logistic curve over its margin."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray):
        """Dual coordinate descent on the squared hinge loss; the last weight is the bias."""
        signs = np.where(positive, 1.0, -1.0)
        weights, alpha = np.zeros(FEATURES + 1), np.zeros(len(rows))
        order = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                at, x = rows[i]
                gradient = signs[i] * (weights[at] @ x + weights[-1]) - 1 + alpha[i] / (2 * COST)
                new = max(0.0, alpha[i] - gradient / (2.0 + 1 / (2 * COST)))
                step, alpha[i] = (new - alpha[i]) * signs[i], new
                if step:
                    weights[at] += step * x
                    weights[-1] += step
        self.weights = weights
        margins = np.array([weights[at] @ x + weights[-1] for at, x in rows])
        self.slope = self._slope(margins * signs)

    @staticmethod
    def _slope(margins: np.ndarray) -> float:
        """The slope of the curve by Newton's method, held back by a weak prior."""
        slope = 1.0
        for _ in range(30):
            p = 1 / (1 + np.exp(slope * margins))
            gradient = (p * margins).sum() - 0.1 * (slope - 4)
            slope += gradient / ((p * (1 - p) * margins**2).sum() + 0.1)
        return float(np.clip(slope, 0.5, 20))

    def probability(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-self.slope * (self.weights[:-1] @ x + self.weights[-1]))))


class Model:
    """The family machines and, per family, the machines of its pairs of languages."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], languages: list[str]):
        languages = np.array(languages, dtype=object)
        families = np.array([FAMILY_OF.get(x, x) for x in languages], dtype=object)
        self.members = {f: sorted(set(languages[families == f])) for f in sorted(set(families))}
        self.families = {f: Machine(rows, families == f) for f in self.members} if len(self.members) > 1 else {}
        self.pairs = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                both = np.flatnonzero((languages == a) | (languages == b))
                self.pairs[a, b] = Machine([rows[i] for i in both], languages[both] == a)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = counts(text)
        if x is None or not self.members:
            return UNDETERMINED, 0.0
        family, certain = next(iter(self.members)), 1.0
        if self.families:
            each = {f: m.probability(x) for f, m in self.families.items()}
            family = max(each, key=each.get)
            certain = each[family] / sum(each.values()) if sum(each.values()) else 1 / len(each)
        members = self.members[family]
        wins = dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            p = self.pairs[a, b].probability(x)
            wins[a] += p
            wins[b] += 1 - p
        language = max(members, key=wins.get)
        return language, certain * (wins[language] / (len(members) - 1) if len(members) > 1 else 1.0)


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", language: str = "lang") -> Model:
    """Fit a model on at most ``per_language`` rows of each language, those whose md5 of ``key`` is lowest.

    Rows without a language, or without a letter in the text, teach nothing. Of an empty
    table comes a model that finds every text undetermined.
    """
    rows = pick(documents, key=key, text=text, language=language).where(F.col("language").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("order", F.coalesce(F.md5(F.col("key").cast("string")), F.lit("")))
    found = {r.language: r["count"] for r in rows.groupBy("language").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return Model([], [])
    # Twice the wanted share by hash leaves few rows to rank; a small group passes whole.
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in found.items() for x in (k, min(1.0, 2 * per_language / n)))), F.col("language"))
    likely = rows.where(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") <= share * 2**32)
    ranked = likely.select("language", "order", "text").withColumn(
        "rank", F.row_number().over(Window.partitionBy("language").orderBy("order", F.xxhash64("text"))))

    @F.pandas_udf("struct<at: array<int>, x: array<float>>")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        each = [counts(t) for t in texts]
        at = [np.flatnonzero(x) if x is not None else np.array([], int) for x in each]
        return pd.DataFrame({"at": [a.tolist() for a in at], "x": [x[a].tolist() if x is not None else [] for a, x in zip(at, each)]})

    sample = ranked.where(F.col("rank") <= per_language).select("language", "order", sparse("text").alias("grams")).collect()
    sample = sorted((r for r in sample if r.grams.at), key=lambda r: (r.order, r.language, r.grams.at))
    return Model([(np.array(r.grams.at), np.array(r.grams.x)) for r in sample], [r.language for r in sample])


def predicted(model: Model, documents: DataFrame, text: Column) -> Column:
    """A struct of lang_pred and score for the whole text of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score`` (0 to 1) for every row.

    A null text, or one without a letter, is ``und`` with score 0. Equal texts get equal
    results. Input columns of those two names are replaced.
    """
    results = ["lang_pred", "score"]
    own = columns_of(documents, *results)
    name, = unused(documents, "found")
    found = documents.select(*own, predicted(model, documents, quoted(text)).alias(name))
    return found.select(*own, *(F.col(name)[c].alias(c) for c in results))
