"""Document quality: a classifier's evidence combined with posteriors of hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tradewind.llm.logistic import fit_dense, sigmoid
from tradewind.llm.shared import stored
from tradewind.llm.words import SPACE, text_chunks, word_hashes

_B = np.arange(256)
#: Classes of bytes: letters (and parts of other characters), capitals, digits, ends of sentences, symbols, line ends.
CLASSES = np.stack([
    ((_B >= 97) & (_B <= 122)) | ((_B >= 65) & (_B <= 90)) | (_B >= 128),
    (_B >= 65) & (_B <= 90), (_B >= 48) & (_B <= 57), np.isin(_B, list(b".!?")), np.isin(_B, list(b"#*$%&|<>{}[]\\^~=_@")), _B == 10, SPACE,
]).astype(np.float64)


def features(texts: pa.Array) -> np.ndarray:
    """Shape of each text: sizes, shares of byte classes, word length, repeated words and pairs of words."""
    out = []
    for _, data, offsets in text_chunks(texts):
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        counts = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256) @ CLASSES.T
        size = np.maximum(np.diff(offsets), 1)[:, None]
        words, starts = word_hashes(data, offsets)
        many = np.diff(starts)
        with np.errstate(over="ignore"):
            pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] if len(words) > 1 else words[:0]
        distinct = np.array([[len(np.unique(words[a:b])), len(np.unique(pairs[a : max(a, b - 1)]))] for a, b in zip(starts[:-1], starts[1:])], float).reshape(n, 2)
        length = (size[:, 0] - counts[:, 6]) / np.maximum(many, 1)
        block = np.column_stack([
            np.log1p(many), counts[:, :6] / size, np.sqrt(counts[:, 4:5] / size), np.log1p(length),
            distinct[:, 0] / np.maximum(many, 1), distinct[:, 1] / np.maximum(many - 1, 1), counts[:, 3] / np.maximum(many, 1), many == 0,
        ])
        out.append(np.column_stack([block, block**2]))
    return np.concatenate(out) if out else np.zeros((0, 26))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return sigmoid(np.column_stack([z, np.ones(len(z))]) @ self.weights)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, l2: float = 1e-3) -> QualityModel:
    """A document classifier from at most `max_rows` labelled rows (ids that hash lowest), whole texts; even odds without labels."""
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id__")).agg(F.max(label_col).cast("double").alias("y"))
    told = told.orderBy(F.xxhash64("id__", F.lit(29)), "id__").limit(max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = docs.select(F.col(id_col).alias("id__"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(told), "id__")
    sample = rows.select(F.col("id__").cast("string").alias("id"), "y", "text").mapInArrow(extract, "id string, y double, x array<double>").orderBy("id").toArrow()
    y = sample.column("y").to_numpy()
    if not len(y):
        return QualityModel(np.zeros(26), np.ones(26), np.zeros(27))
    x = np.array(sample.column("x").to_pylist())
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    return QualityModel(mean, scale, fit_dense(np.column_stack([z, np.ones(len(z))]), y, l2))


def site_quality(
    docs: DataFrame, model: QualityModel, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """Quality of each document: its own evidence moved by what its host and path usually hold.

    The classifier's probabilities are summed by host and by path within the host. With mean m of all documents, a host's
    posterior is (sum - own + k m) / (n - 1 + k): the document itself is left out, and a host with few documents stays
    near m. A path is shrunk towards its host in the same way. The strengths k follow from the data (empirical Bayes,
    method of moments): the more hosts differ beyond what their documents' spread explains, the smaller. The score adds
    the path posterior's log-odds, relative to m, to the document's.

    Null hosts and paths are groups of their own; null texts are empty ones. Repeated rows count each by itself; other
    columns are not read; an empty table gives no rows. Kept: score of `least` or more.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.clip(model.score(features(batch.column("text"))), 1e-4, 1 - 1e-4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(p)], names=["doc_id", "host", "path", "p"])

    key = lambda c: F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))
    named = docs.select(F.col(id_col).alias("doc_id"), key(host).alias("host"), key(path).alias("path"), F.col(text_col).cast("string").alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    scored = stored(named.mapInArrow(judge, f"doc_id {kind}, host string, path string, p double"), "document_scores")
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("pn"), F.sum("p").alias("ps"), F.sum(F.col("p") * F.col("p")).alias("pq")), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"), F.sum("pq").alias("hq")), "hosts")

    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    m = (total["s"] or 0.5) / (total["n"] or 1)
    own = hosts.withColumns({"mean": F.col("hs") / F.col("hn"), "within": F.greatest(F.col("hq") / F.col("hn") - (F.col("hs") / F.col("hn")) ** 2, F.lit(0.0))})
    host_k = _strength(own.select("hn", "mean", "within", F.lit(m).alias("parent")), "hn")
    inner = paths.join(hosts, "host").select(
        "pn",
        (F.col("ps") / F.col("pn")).alias("mean"),
        F.greatest(F.col("pq") / F.col("pn") - (F.col("ps") / F.col("pn")) ** 2, F.lit(0.0)).alias("within"),
        (F.col("hs") / F.col("hn")).alias("parent"),
    )
    path_k = _strength(inner, "pn")
    joined = scored.join(hosts.select("host", "hn", "hs"), "host").join(paths.select("host", "path", "pn", "ps"), ["host", "path"])
    host_score = (F.col("hs") - F.col("p") + host_k * m) / (F.col("hn") - 1 + host_k)
    path_score = (F.col("ps") - F.col("p") + path_k * F.col("host_score")) / (F.col("pn") - 1 + path_k)
    logit = lambda x: F.log(x / (F.lit(1.0) - x))
    inside = lambda x: F.least(F.greatest(x, F.lit(1e-4)), F.lit(1 - 1e-4))
    out = joined.withColumn("host_score", inside(host_score)).withColumn("path_score", inside(path_score))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(logit(F.col("p")) + logit(F.col("path_score")) - float(np.log(m / (1 - m)) if 0 < m < 1 else 0.0))))
    return out.select("doc_id", score.alias("score"), F.col("p").alias("document_score"), "host_score", "path_score").withColumn("kept", F.col("score") >= least)


def _strength(groups: DataFrame, n: str) -> float:
    """How many documents the parent's mean counts as: spread within groups over spread between them, 1 to 10,000."""
    between = F.sum(F.col(n) * ((F.col("mean") - F.col("parent")) ** 2 - F.col("within") / F.col(n))) / F.sum(n)
    row = groups.agg((F.sum(F.col(n) * F.col("within")) / F.sum(n)).alias("within"), between.alias("between")).first()
    if not row["within"]:
        return 1.0
    return float(min(1e4, max(1.0, row["within"] / max(row["between"], 1e-9))))
