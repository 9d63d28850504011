"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .pretokens import code_points, text_runs

LOWER, UPPER, DIGIT, BLANK, STOP, SIGN = range(6)
STATISTICS = ("words", "word_length", "variety", "signs", "capitals", "digits", "stops", "line_length", "repeated_lines", "repeated_words", "odd_words")
#: Shrinkage of a class covariance towards its diagonal, and the variance added to every statistic.
SHRINKAGE, RIDGE = 0.1, 0.01
SEEN = 20


@lru_cache(1)
def _kinds() -> np.ndarray:
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    kinds = np.full(0x110000, SIGN, np.uint8)
    for kind, pattern in ((LOWER, r"[\p{L}\p{M}]"), (UPPER, r"\p{Lu}"), (DIGIT, r"\p{N}"), (BLANK, r"\s"), (STOP, r"[.,;:?'\"()-]")):
        kinds[code_points("".join(regex.findall(pattern, every)))] = kind
    return kinds


def _odds(part: float, whole: float, usual: float) -> float:
    """Log odds of a share, drawn to the usual share as if SEEN more cases had been seen: short texts say little."""
    return float(np.log((part + SEEN * usual) / (whole - part + SEEN * (1 - usual))))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text: logarithms of sizes and log odds of shares."""
    kinds = np.bincount(_kinds()[code_points(text)], minlength=6)
    words = text.split()
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n, letters = len(words), kinds[LOWER] + kinds[UPPER]
    solid = int(kinds.sum() - kinds[BLANK])
    signs = [w for w in counts if not w[-1].isalnum() and w[-1] not in ".,;:?'\"()-"]
    return [
        float(np.log1p(n)),
        float(np.log((solid + 5 * SEEN) / (n + SEEN))),
        float(np.log((len(counts) + 1) / (n + 1)) + 0.1 * np.log1p(n)),
        _odds(kinds[SIGN], solid, 0.01),
        _odds(kinds[UPPER], letters, 0.03),
        _odds(kinds[DIGIT], solid, 0.01),
        _odds(kinds[STOP], solid, 0.04),
        float(np.log((n + SEEN) / (len(lines) + 1))),
        _odds(len(lines) - len(set(lines)), len(lines), 0.02),
        _odds(sum(a == b for a, b in zip(words, words[1:], strict=False)), n, 0.02),
        _odds(sum(counts[w] for w in signs), n, 0.02),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of its whole text; a map over rows, in runs of bounded length beside one long text. Null
    texts count as empty."""

    def run(parts):
        for part in parts:
            for ids, texts in text_runs(part.column(0), part.column(1)):
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(list(map(statistics, texts)), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, x array<double>")


def held_out(id_col: str | Column) -> Column:
    """One id in five, by the checksum of its digits; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


class QuadraticDiscriminant:
    """Log density difference of two Gaussian classes, with each class's Cholesky factor kept."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """moments: for each class the number of rows, the sums, and the sums of products."""
        total = sum(n for n, _, _ in moments.values())
        self.classes = {}
        for label, (n, s, ss) in moments.items():
            mean = s / n
            cov = ss / n - np.outer(mean, mean)
            cov = (1 - SHRINKAGE) * cov + SHRINKAGE * np.diag(np.diag(cov)) + RIDGE * np.eye(len(mean))
            factor = np.linalg.cholesky(cov)
            self.classes[label] = (mean, np.linalg.inv(factor), np.log(n / total) - np.log(np.diag(factor)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1; 1 or 0 if only one class was seen, 0.5 if none."""
        if len(self.classes) < 2:
            return np.full(len(x), float(next(iter(self.classes))) if self.classes else 0.5)
        log = {k: c - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for k, (mean, inverse, c) in self.classes.items()}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(labelled: DataFrame) -> QuadraticDiscriminant:
    """From x and quality of every labelled row: sums and products by class are one aggregate with partial sums."""
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i, j in pairs]
    moments = {}
    for label, n, *s in labelled.groupBy("quality").agg(F.count("*"), *sums).collect():  # two rows
        ss = np.zeros((d, d))
        for (i, j), v in zip(pairs, s[d:], strict=True):
            ss[i, j] = ss[j, i] = v
        moments[int(label)] = (float(n), np.array(s[:d]), ss)
    return QuadraticDiscriminant(moments)


def _marks(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted.

    Fitted on all rows of labels whose id is not held out and whose quality is 0 or 1 (no sample); labels, language,
    source and id are not inputs of a score. Null and empty texts are scored by their statistics; repeated rows each
    get the score; rows with a null id are scored as not held out; other columns are ignored, whatever their names; an
    empty table gives an empty result; texts of any length are measured whole; without labels of both classes the score
    is that of the class seen, or 0.5.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "quality-statistics")
    model = fit(stats.join(_marks(labels), "doc_id"))

    def run(parts):
        for part in parts:
            x = part.column(2).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(model.scores(x))], names=["doc_id", "held_out", "score"])

    scored = stats.select("doc_id", held_out("doc_id").alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 500_000) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; else as score_documents.

    Fitted on labelled rows, a sample of about train_rows of them if there are more: their ids are broadcast, so that only
    their texts are measured for the fit. Then rows are filtered where they are read: texts are not shuffled or stored.
    """
    marks = _marks(labels)
    marks = marks.sample(min(1.0, train_rows / max(1, marks.count())), 4)
    labelled = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marks.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit(document_statistics(labelled).join(marks, "doc_id"))
    place = docs.columns.index(text_col)

    def run(parts):
        for part in parts:
            at = 0
            for some, texts in text_runs(part.column(place), part.column(place)):
                x = np.array(list(map(statistics, texts))).reshape(-1, len(STATISTICS))
                yield part.slice(at, len(some)).filter(pa.array(model.scores(x) >= threshold))
                at += len(some)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
