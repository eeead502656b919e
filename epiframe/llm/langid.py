"""Language identification in two steps: the family first, then one-versus-one linear support vector machines inside it.

Features are shares of hashed byte trigrams of the lower-cased letters, so a decision is one product of a text's histogram with a
weight matrix.  Weights are fitted on a bounded sample; every text is predicted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

DIM = 4096
#: Labelled texts in the fitting sample, over all languages together.
SAMPLE = 2400
UNKNOWN = "und"
#: Families of closely related languages by their codes; a language outside is a family of its own.
FAMILIES = {"germanic": ("en", "sco", "de", "nl", "af", "lb", "yi"), "nordic": ("da", "no", "nb", "nn", "sv", "is", "fo"), "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
            "slavic_east": ("ru", "uk", "be"), "slavic_west": ("pl", "cs", "sk"), "slavic_south": ("sr", "hr", "bs", "sl", "mk", "bg"), "baltic": ("lt", "lv"), "finnic": ("fi", "et"), "turkic": ("tr", "az", "kk", "uz")}

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def family_of(language: str, families=FAMILIES) -> str:
    return next((f for f, members in families.items() if language in members), f"only {language}")


def histograms(texts: list[bytes]) -> np.ndarray:
    """Shares of the hashed letter trigrams of each text, one row a text; rows of texts without any are zero."""
    letters = _LETTER[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)].astype(np.uint32)       # a trigram belongs to the text of its middle letter
    codes = (letters[:-2] * np.uint32(2654435761) + letters[1:-1] * np.uint32(2246822519) + letters[2:] * np.uint32(3266489917)) >> np.uint32(20)
    real = (letters[1:-1] != 32)
    owner = np.repeat(np.arange(len(texts)), [len(x) + 2 for x in texts])[:-2]
    counts = np.bincount(owner[real] * DIM + codes[real], minlength=len(texts) * DIM).reshape(len(texts), DIM).astype(np.float32)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights of the squared-hinge machine by dual coordinate descent; ``y`` is +1 or -1."""
    norm, weight = np.einsum("ij,ij->i", x, x) + 0.5 / c, np.zeros(x.shape[1], np.float32)
    alpha, order = np.zeros(len(x), np.float32), np.random.RandomState(5)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = (1 - y[i] * float(x[i] @ weight) - alpha[i] * 0.5 / c) / norm[i]
            new = max(0.0, alpha[i] + step)
            if new != alpha[i]:
                weight += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return weight


@dataclass
class Model:
    """Languages by family and one weight column for each family, then for each pair of languages of one family."""

    families: list[list[str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM + 1, 0), np.float32))

    @property
    def languages(self) -> list[str]:
        return [x for f in self.families for x in f]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        margin = histograms(texts) * SCALE @ self.weights[:-1] + self.weights[-1]
        n, at = len(self.families), len(self.families)
        e = np.exp(2.0 * np.clip(margin[:, :n], -30, 30).astype(np.float64))
        share = e / e.sum(1, keepdims=True)
        family = share.argmax(1)
        score, best = share[np.arange(len(texts)), family], np.empty(len(texts), object)
        for i, members in enumerate(self.families):
            mine, votes = family == i, np.zeros((len(texts), len(members)))
            for a, b in combinations(range(len(members)), 2):
                p = 1 / (1 + np.exp(-2.0 * np.clip(margin[:, at].astype(np.float64), -30, 30)))
                votes[:, a] += (p >= 0.5) + p / len(members) ** 2
                votes[:, b] += (p < 0.5) + (1 - p) / len(members) ** 2
                at += 1
            pick = votes.argmax(1)
            best[mine] = np.array(members, object)[pick[mine]]
            if len(members) > 1:
                total = votes.sum(1)
                score = np.where(mine, score * votes[np.arange(len(texts)), pick] / (total * 2 / len(members)), score)
        return best.tolist(), np.clip(score, 0.0, 1.0)


#: Shares are multiplied by this, so that a text has a norm of about one.
SCALE = np.float32(10.0)


def fit(labelled: DataFrame, text: str, language: str, sample: int = SAMPLE, families=FAMILIES) -> Model:
    """Fit on about ``sample`` texts of ``labelled`` (1.3 times as many are drawn), as many of each language where there are as many, drawn by hash.

    Repeated texts of a language count once, so a group of copies is one text.  Rows without language or text are left out; without any
    row the model knows no language.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(f"`{language}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: max(1, r[1]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"))).collect()}
    if not counts:
        return Model()
    each = max(1, sample // len(counts))
    shares = spark.createDataFrame([(k, min(1.0, 1.3 * each / n)) for k, n in counts.items()], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).dropDuplicates(["lang", "text"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([x.tobytes() for x in histograms(texts)], pa.binary())], names=["lang", "x"])
    got = drawn.select("lang", "text").mapInArrow(features, "lang string, x binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    y = np.array([r.lang for r in got])
    x = np.ones((len(got), DIM + 1), np.float32)               # the last column is the intercept's
    while got:
        x[len(got) - 1, :-1] = np.frombuffer(got.pop().x, np.float32) * SCALE
    names = sorted(set(y.tolist()))
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(family_of(name, families), []).append(name)
    model = Model([groups[f] for f in sorted(groups)])
    columns = []
    for members in model.families:
        inside = np.isin(y, members)
        columns.append(linear_svm(x, np.where(inside, 1, -1)) if not inside.all() else np.zeros(DIM + 1, np.float32))
    for members in model.families:
        for a, b in combinations(members, 2):
            two = (y == a) | (y == b)
            columns.append(linear_svm(x[two], np.where(y[two] == a, 1, -1)))
    model.weights = np.stack(columns, axis=1) if columns else model.weights
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred and score (columns of these names are replaced).

    Null texts, texts without a letter and any text under a model without languages are ``und`` with score 0.  The other columns,
    repeated rows and null identifiers pass through.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    own = "_letters"
    while own in names:
        own += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text):
                known = np.array(part.column(own).to_pylist(), bool) & bool(model.families)
                best, score = model.predict(texts) if model.families else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array([b if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, score, 0.0))], names=[*names, "lang_pred", "score"])
    return docs.withColumn(own, has_letter(F.col(f"`{text}`"))).mapInArrow(run, schema)
