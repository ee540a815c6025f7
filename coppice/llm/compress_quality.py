"""A quality classifier made of compressors.

Two zstandard dictionaries are trained, one on good and one on bad labelled
text. A text is cut into pieces of ``PIECE`` bytes (all of it, no prefix); every
piece is compressed with either dictionary, and the normalised difference of
the summed sizes (bad - good) / (bad + good) says which class explains the text
better. A logistic curve over that difference, its evidence-weighted form,
the compressed share of the text's own size (endless repeats compress to almost
nothing) and the text's length, fitted on labelled rows that the dictionaries have not seen,
turns it into a score from 0 to 1.

The fit uses a bounded sample: the ``PER_CLASS`` labelled rows of each class
with the least hash of the id. Every second of them gives the dictionaries' text,
at most ``PER_TEXT`` pieces a text, spread evenly from its beginning to its end;
the others give the curve, from whole texts and where they lie: only five numbers
a text come to the driver. Everything else covers all rows and all of each text.

Null and empty texts have difference 0 and get the curve's value there. Rows are
independent, so repeated rows and empty tables need nothing special; a text may
be of any length. An id whose labels conflict counts as 1; of several texts of one id
the least is learned from. Without labelled rows of both classes there is nothing to tell apart:
every text gets the smoothed share of label 1 (0.5 without any labelled row).
Extra columns are kept, whatever their names; ``score`` and ``predicted`` give
way to the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import guarded, picked

PIECE = 1024
DICTIONARY = 48 * 1024
LEVEL = 3
PER_CLASS = 2000
#: Pieces of one sampled document that go into a dictionary's training, from all over it.
PER_TEXT = 32


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def compressors(good: bytes, bad: bytes) -> tuple:
    import zstandard

    out = []
    for content in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
    return tuple(out)


def features(raw: bytes, compress: tuple) -> tuple[float, ...]:
    """Normalised size difference, the same weighted by evidence, how far the text itself can be compressed, and log length."""
    good, bad = compress
    a = b = 0
    for piece in pieces(raw):
        a, b = a + len(good(piece)), b + len(bad(piece))
    d = (b - a) / (a + b) if a + b else 0.0
    evidence = min(1.0, len(raw) / PIECE)
    ratio = np.log(max(min(a, b), 1) / len(raw)) if raw else 0.0
    return d, d * evidence, ratio, ratio * evidence, np.log1p(len(raw)) / 10


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method on the ridge-penalised log-likelihood; the last column is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.eye(len(w)) * ridge * len(x) / 100
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    samples = [p for p in samples if len(p) >= 8]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its raw content serves as the dictionary
        return b"".join(samples)[-DICTIONARY:] or b"\0" * 8


def spread(raw: bytes, most: int = PER_TEXT) -> list[bytes]:
    """At most so many pieces, evenly spread over the whole text."""
    n = -(-len(raw) // PIECE)
    return [raw[i * PIECE : (i + 1) * PIECE] for i in (range(n) if n <= most else sorted({round(k * (n - 1) / (most - 1)) for k in range(most)}))]


def fit(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id and the label, 0 or 1).

    Dictionaries come from every second sampled row of a class, the curve from the others, which the dictionaries
    have not seen; the only row of a class serves both.
    """
    spark, docs, labels = docs.sparkSession, picked(docs, "doc_id", "text"), picked(labels, "doc_id", label)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    # only ids come to the driver, at most ``per_class`` of each class
    there = docs.where(F.col("text").isNotNull()).select("doc_id")
    chosen = []
    for c in (0, 1):
        rows = known.where(F.col("_label") == c).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id").collect()
        chosen += [(r["doc_id"], c, i % 2 if len(rows) > 1 else -1) for i, r in enumerate(rows)]
    kinds = {c for _, c, _ in chosen}
    if len(kinds) < 2:
        share = (sum(c for _, c, _ in chosen) + 1) / (len(chosen) + 2)
        return Model(b"\0" * 8, b"\0" * 8, (0.0, 0.0, 0.0, 0.0, 0.0, float(np.log(share / (1 - share)))))
    folds = spark.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _label int, _fold int")
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(folds), "doc_id")
    rows = rows.groupBy("doc_id", "_label", "_fold").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([spread(v.as_buffer().to_pybytes()) for v in batch.column("text")], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), made], names=["doc_id", "_label", "pieces"])

    samples: tuple[list[bytes], list[bytes]] = ([], [])
    schema = rows.select("doc_id", "_label", F.array(F.lit(b"")).alias("pieces")).schema
    for r in rows.where("_fold <= 0").mapInArrow(cut, schema).orderBy("doc_id").collect():
        samples[r["_label"]].extend(map(bytes, r["pieces"]))
    bad, good = dictionary(samples[0]), dictionary(samples[1])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = compressors(good, bad)
        for batch in batches:
            made = pa.array([features(v.as_buffer().to_pybytes(), compress) for v in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), made], names=["doc_id", "_label", "x"])

    schema = rows.select("doc_id", "_label", F.array(F.lit(0.0)).alias("x")).schema
    points = rows.where("_fold != 0").mapInArrow(measured, schema).orderBy("doc_id").collect()
    return Model(good, bad, tuple(logistic(np.array([r["x"] for r in points]), np.array([float(r["_label"]) for r in points])).tolist()))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (double) and ``predicted`` (int, 1 where score >= threshold)."""
    return guarded(docs, (text,), lambda d: _scored(d, model, threshold, text))


def _scored(docs: DataFrame, model: Model, threshold: float, text: str) -> DataFrame:
    keep = docs.columns
    schema = docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, w = compressors(model.good, model.bad), np.array(model.weights)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                x = np.array([features(v.as_buffer().to_pybytes() if v.is_valid else b"", compress) for v in part.column(text)])
                score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(run, schema)
