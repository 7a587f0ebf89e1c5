"""Scores of one text against another: ROUGE and BLEU over words split at white space."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n))))


def _f(common: int, a: int, b: int) -> float:
    return 0.0 if not common else 2 * common / (a + b)


def longest_common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge(a: list[str], b: list[str]) -> tuple[float, float, float]:
    """F measures of common words, word pairs and the longest common subsequence."""
    out = []
    for n in (1, 2):
        x, y = _grams(a, n), _grams(b, n)
        out.append(_f(sum((x & y).values()), x.total(), y.total()))
    return out[0], out[1], _f(longest_common(a, b), len(a), len(b))


def bleu(prediction: list[str], reference: list[str]) -> float:
    """BLEU of four orders; the k-th order without a hit counts as 1 / (2^k of its n-grams)."""
    if not prediction or not reference:
        return 0.0
    total, misses = 0.0, 0
    for n in range(1, 5):
        x, y = _grams(prediction, n), _grams(reference, n)
        hits, size = sum((x & y).values()), max(1, x.total())
        if n == 1 and not hits:
            return 0.0
        if not hits:
            misses += 1
        total += math.log(hits / size if hits else 1 / (2**misses * size)) / 4
    return min(1.0, math.exp(1 - len(reference) / len(prediction))) * math.exp(total)


def scored(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Adds ``rouge_1, rouge_2, rouge_l, bleu_4`` in percent; null texts count as empty."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            p, r = (x or "").split(), (y or "").split()
            rows.append([round(100 * v, 6) for v in (*rouge(p, r), bleu(p, r))])
        return pd.DataFrame(rows, columns=["rouge_1", "rouge_2", "rouge_l", "bleu_4"])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    score = F.pandas_udf(run, "rouge_1 double, rouge_2 double, rouge_l double, bleu_4 double")
    return df.withColumn("_s", score(prediction, reference)).select(*df.columns, "_s.*")
