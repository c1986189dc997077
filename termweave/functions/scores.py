"""Column functions for scores: sets, words, vectors, trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the final score.
TEXT_WEIGHT, ASSERTION_WEIGHT, CANDIDATE_WEIGHT = 0.3, 0.3, 0.4


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def final_score(text: Column, assertions: Column, candidates: Column) -> Column:
    return text * TEXT_WEIGHT + assertions * ASSERTION_WEIGHT + candidates * CANDIDATE_WEIGHT


def word_edits(a: list[str], b: list[str]) -> int:
    """Least number of words inserted, deleted or replaced."""
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64) for words in (a, b))
    places = np.arange(len(y) + 1)
    row = places.copy()
    for k, word in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != word))
        # insertions run along the row: a running minimum of the distance to the diagonal
        row = np.minimum.accumulate(np.concatenate([[k], best]) - places) + places
    return int(row[-1])


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits of words over words of the reference; an empty reference gives 0 or 1.

    ``reference`` and ``hypothesis`` are word arrays. The edit table is filled row by row in
    Arrow batches; there is no built-in function on words.
    """

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(word_edits(x, y) / len(x) if len(x) else float(len(y) > 0)) if x is not None and y is not None else None for x, y in zip(a, b)], dtype=float)

    return F.pandas_udf(run, "double")(reference, hypothesis)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine similarity; a zero vector on the document side counts as a tiny one."""
    tiny = F.lit(1e-9)
    return dot(a, b) / (norm_a * F.when(norm_b == 0, tiny).otherwise(norm_b))


def common_depth(left: Column, right: Column) -> Column:
    """Depth of the last common node of two root-to-node paths; null if there is none."""
    n = F.size(F.filter(F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same))
    return F.when(n > 0, n - 1)


def common_ancestor(left: Column, right: Column) -> Column:
    return F.get(left, common_depth(left, right))


def path_depth(path: Column) -> Column:
    return F.size(path) - 1


def tree_distance(left: Column, right: Column) -> Column:
    return path_depth(left) + path_depth(right) - 2 * common_depth(left, right)


def wu_palmer(left: Column, right: Column) -> Column:
    total = path_depth(left) + path_depth(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * common_depth(left, right) / total)


def ontology_penalty(left: Column, right: Column, rate: float = 0.7) -> Column:
    return F.exp(-rate * (1 - wu_palmer(left, right)))
