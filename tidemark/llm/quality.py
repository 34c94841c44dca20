"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document becomes a row of length-independent statistics, transformed towards a bell shape.
Each class has a mean and a shrunk covariance, (1 - a) S_c + a ((1 - g) S_pooled + g diag(S_pooled)),
whose Cholesky factor is computed once and shipped to the workers; the score is the logistic of the
classes' log-density difference (half Mahalanobis distances and log determinants) plus the log prior.

Features are computed once per document; fitting needs one join of the feature rows with the labels
and one aggregation of sums, sums of products and counts per class, so only a few hundred numbers
come to the driver whatever the number of rows.

Defined cases: null or empty text has the statistics of the empty text and gets a score; a null
doc_id counts as held out (crc32 of the empty string is 0, hence not 2: it is false) and is never
learnt from; labels that are null are ignored; a document labelled twice counts twice; if a class
has no rows the score is the prior; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import documents, texts, written

THRESHOLD, WINDOW = 0.7, 64
NAMES = ("length", "word_length", "upper", "symbol", "digit", "doubled_symbol", "bare_symbol", "variety", "repeat", "top_word", "line_words", "line_repeat", "stops", "long_words")
UPPER, LOWER, DIGIT, SPACE, SYMBOL, OTHER = range(6)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Kind of each code point by its Unicode category."""
    first = {"L": LOWER, "N": DIGIT, "Z": SPACE, "P": SYMBOL, "S": SYMBOL, "M": LOWER}
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for start in range(0, 0x30000):
        kind = unicodedata.category(chr(start))
        out[start] = UPPER if kind in ("Lu", "Lt") else first.get(kind[0], OTHER)
    out[[9, 10, 11, 12, 13]] = SPACE
    return out


_WORD_END = re.compile(r"[.!?]")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _classes()[codes]
    n = np.bincount(kinds, minlength=6)
    letters, chars = max(1, n[UPPER] + n[LOWER]), max(1, len(codes) - n[SPACE])
    symbol = kinds == SYMBOL
    doubled = int(((codes[1:] == codes[:-1]) & symbol[1:]).sum()) if len(codes) > 1 else 0
    alone = symbol.copy()
    if len(codes):
        space = kinds == SPACE
        alone[1:] &= space[:-1]
        alone[:-1] &= space[1:]
    words = text.split()
    w = max(1, len(words))
    repeat = sum(map(eq, words[1:], words))
    seen = [len(set(words[i : i + WINDOW])) / len(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)] or [1.0]
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = list(map(len, words))
    return [
        np.log1p(len(codes)),
        np.log1p(sum(sizes) / w),
        np.sqrt(n[UPPER] / letters),
        np.sqrt(n[SYMBOL] / chars),
        np.sqrt(n[DIGIT] / chars),
        np.sqrt(doubled / chars),
        np.sqrt(int(alone.sum()) / w),
        sum(seen) / len(seen),
        np.sqrt(repeat / w),
        np.log((top + 1) / (w + 10)),
        np.log1p(w / max(1, len(lines))),
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))) if lines else 0.0,
        np.sqrt(len(_WORD_END.findall(text)) / w),
        np.sqrt(sum(s > 14 for s in sizes) / w),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x.as_py()) for x in batch.column("text")]
        flat = pa.array(np.fromiter(chain.from_iterable(rows), dtype=np.float64, count=len(rows) * len(NAMES)))
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts(docs, id_col, text_col).mapInArrow(_features, "doc_id long, x array<double>")


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


@dataclass
class Discriminant:
    means: list
    factors: list  # inverse Cholesky factors
    log_dets: list
    log_prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, inverse, log_det in zip(self.means, self.factors, self.log_dets):
            z = (x - mean) @ inverse.T
            logs.append(-0.5 * (np.einsum("ij,ij->i", z, z) + log_det))
        t = (logs[1] - logs[0] if logs else np.zeros(len(x))) + self.log_prior
        return 1 / (1 + np.exp(-np.clip(t, -700, 700)))


def moments_to_model(n: np.ndarray, s: np.ndarray, ss: np.ndarray, shrink: float, spherical: float) -> Discriminant:
    """From counts (2), sums (2, d) and sums of products (2, d, d)."""
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Discriminant([], [], [], prior)
    means = s / n[:, None]
    cov = ss / n[:, None, None] - np.einsum("ci,cj->cij", means, means)
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    between = np.diag(pooled) + 1e-6
    target = (1 - spherical) * pooled + spherical * np.diag(between)
    factors, dets = [], []
    for c in cov:
        chol = np.linalg.cholesky((1 - shrink) * c + shrink * target + 1e-9 * np.eye(len(c)))
        factors.append(np.linalg.inv(chol))
        dets.append(2 * float(np.log(np.diag(chol)).sum()))
    return Discriminant(list(means), factors, dets, prior)


def fit(rows: DataFrame, shrink: float = 0.05, spherical: float = 0.5) -> Discriminant:
    """Fit on (x, label): one aggregation of sums of products."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    found = rows.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()  # a row per class
    n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in found:
        c = int(row["label"])
        n[c], s[c] = row["n"], [row[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            ss[c, i, j] = ss[c, j, i] = row[f"p{i}_{j}"]
    return moments_to_model(n, s, ss, shrink, spherical)


def _learnt(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """The model of (doc_id, x) with a label that isn't held out."""
    marks = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    return fit(rows.join(marks.where(~held_out(F.col("doc_id"))), "doc_id").select("x", "label"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Discriminant]:
    """(features of all documents, model learnt from those with a label that isn't held out)."""
    rows = written(features(docs, id_col, text_col), "features")
    return rows, _learnt(rows, labels)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    rows, model = train(docs, labels, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(x))], ["doc_id", "held_out", "score"])

    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the classifier rejects, each row judged by its own text.

    The statistics are taken once and written beside the rows, so that neither texts are shuffled nor statistics taken again."""

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py() or "") for x in batch.column(text_col)]
            yield batch.append_column("_tm_x", pa.array(rows, pa.list_(pa.float64())))

    rows = written(docs.mapInArrow(beside, T.StructType([*docs.schema.fields, T.StructField("_tm_x", T.ArrayType(T.DoubleType()))])), "judged")
    model = _learnt(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col("_tm_x").alias("x")), labels)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_tm_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield batch.drop_columns(["_tm_x"]).filter(pa.array(model.scores(x) >= threshold))

    return rows.mapInArrow(good, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
