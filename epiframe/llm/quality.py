"""Quality classifier: a sparse ensemble of rules.

The paths of a small forest over text statistics become conjunctive rules; a lasso logistic regression weighs the rules and the
statistics themselves; what keeps a weight is compiled into one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, word_hashes

STATISTICS = ("log_bytes", "log_words", "word_length", "longest_word", "letters", "capitals", "digits", "symbols", "marks", "bangs", "bars", "lines", "stops", "distinct_words", "repeated_next", "words_with_symbol",
              "capital_words", "commonest_word", "lone_letters", "bigram_variety")

_KINDS = np.zeros((8, 256), bool)
_KINDS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True        # letters
_KINDS[1, 65:91] = True                                                     # capitals
_KINDS[2, 48:58] = True                                                     # digits
_KINDS[3, list(b"#$%&*+/<=>@\\^_`{}~[]")] = True                            # symbols
_KINDS[4, list(b",;:'\"()-?")] = True                                       # marks
_KINDS[5, list(b"!")] = True
_KINDS[6, list(b"|")] = True
_KINDS[7, list(b"\n")] = True


def statistics_of(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    n = len(texts)
    out = np.zeros((n, len(STATISTICS)))
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(x) for x in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    bytes_ = np.maximum(sizes, 1)
    totals = np.stack([np.add.reduceat(k[buf], starts, dtype=np.int64) for k in _KINDS])
    stops = np.add.reduceat(buf == 46, starts, dtype=np.int64)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~space, [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    hashes, at = word_hashes(texts)
    words = np.diff(at)
    some = np.maximum(words, 1)
    length = end - begin
    last_symbol = _KINDS[3][buf[end - 1]] | _KINDS[5][buf[end - 1]] | _KINDS[6][buf[end - 1]] if len(end) else np.zeros(0, bool)
    capital = _KINDS[1][buf[begin]] if len(begin) else np.zeros(0, bool)

    def over_words(x):
        return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at])
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    if n:
        out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(words)
        out[:, 2] = over_words(length) / some
        out[:, 4] = totals[0] / bytes_
        out[:, 5] = totals[1] / np.maximum(totals[0], 1)
        for j, k in ((6, 2), (7, 3), (8, 4), (9, 5), (10, 6)):
            out[:, j] = totals[k] / bytes_
        out[:, 11] = totals[7] / some
        out[:, 12] = stops / some
        out[:, 14] = over_words(same) / some
        out[:, 15] = over_words(last_symbol) / some
        out[:, 16] = over_words(capital) / some
        out[:, 18] = over_words(length == 1) / some
    for i in np.flatnonzero(words):
        own = hashes[at[i]:at[i + 1]]
        _, counts = np.unique(own, return_counts=True)
        out[i, 3] = length[at[i]:at[i + 1]].max()
        out[i, 13] = len(counts) / len(own)
        out[i, 17] = counts.max() / len(own)
        out[i, 19] = len(np.unique(own[1:] ^ (own[:-1] << np.uint64(1)))) / max(1, len(own) - 1)
    return out


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text and with STATISTICS (columns of these names are replaced); a null text counts as empty."""
    docs = docs.drop(*STATISTICS)
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in rest], *[T.StructField(s, T.DoubleType()) for s in STATISTICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text):
                x = statistics_of(texts)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *[pa.array(x[:, j]) for j in range(x.shape[1])]], names=[*rest, *STATISTICS])
    return docs.mapInArrow(run, schema)


#: A rule is a set of (statistic, is above, threshold).
Rule = frozenset


def tree_rules(node, path: tuple = ()) -> Iterator[Rule]:
    """Every path from below the root of a fitted tree to a node, as the tightest conjunction of its splits."""
    if path:
        tight: dict = {}
        for j, above, t in path:
            tight[j, above] = t if (j, above) not in tight else (max if above else min)(t, tight[j, above])
        yield Rule((j, above, t) for (j, above), t in tight.items())
    if node.subtreeDepth():
        j, t = node.split().featureIndex(), node.split().threshold()
        yield from tree_rules(node.leftChild(), (*path, (j, False, t)))
        yield from tree_rules(node.rightChild(), (*path, (j, True, t)))


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for j, above, t in sorted(rule):
        c = F.col(STATISTICS[j])
        out = out & (c > t if above else c <= t)
    return out


@dataclass
class RuleEnsemble:
    """Weights on rules and on statistics; ``score`` is the compiled column."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[int, float]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        for j, weight in self.linear:
            total = total + F.col(STATISTICS[j]) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(total, F.lit(-40.0)), F.lit(40.0))))


def fit(labelled: DataFrame, label: str, trees: int = 10, depth: int = 4, penalty: float = 0.0005, seed: int = 17) -> RuleEnsemble:
    """Fit on all rows of ``labelled`` (STATISTICS and a 0/1 label); a null label is left out.

    Without rows every score is one half; with one label only it is that label, up to rounding.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), *STATISTICS)
    counts = {int(r[0]): r[1] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return RuleEnsemble(0.0 if not counts else 40.0 if counts.get(1) else -40.0)
    plain = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("x"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=seed).fit(plain)
    found: dict[Rule, None] = {}
    for tree in forest.trees:
        for rule in tree_rules(tree._java_obj.rootNode()):
            found.setdefault(rule)
    rules = list(found)
    columns = [*[rule_column(r).cast("double") for r in rules], *[F.col(s) for s in STATISTICS]]
    wide = rows.select("label", array_to_vector(F.array(*columns)).alias("x"))
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(wide)
    weights = lasso.coefficients.toArray().tolist()
    kept = [(r, w) for r, w in zip(rules, weights, strict=False) if w]
    return RuleEnsemble(float(lasso.intercept), kept, [(j, w) for j, w in enumerate(weights[len(rules):]) if w])
