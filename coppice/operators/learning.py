"""Linear models over tables of vectors: gradients of a softmax classifier by chunk, and predictions with a failure column."""

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a model that may go to every worker.
MODEL_BYTES = 256 << 20


def packed(weights: np.ndarray, bias: np.ndarray) -> bytes:
    """A linear model (classes x components, classes) as the bytes that workers load."""
    out = io.BytesIO()
    np.savez(out, weights=np.asarray(weights, np.float64), bias=np.asarray(bias, np.float64))
    if out.tell() > MODEL_BYTES:
        raise ValueError(f"a model of {out.tell()} bytes is too large to be sent to every worker")
    return out.getvalue()


def _loaded(model: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(model)) as f:
        return f["weights"], f["bias"]


def _matrix(array: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the model's length, finite in all components, as rows, and which of the array's they are."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(array), -1))
    fits = np.flatnonzero(sizes == width)
    x = np.asarray(pa.compute.cast(array.take(pa.array(fits)).flatten(), pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, width)
    fine = np.isfinite(x).all(axis=1)
    return x[fine], fits[fine]


def predicted(df: DataFrame, model: bytes, vector: str = "vector") -> DataFrame:
    """``df`` plus ``predicted`` (the first class with the greatest score), ``score`` and ``failure`` (null, or why there is no prediction).

    A worker loads the model once, from a broadcast, and takes batches as matrix products. A vector that is null, of another length
    or not finite has no prediction and says so; it fails no task.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select("*", F.lit(None).cast("int").alias("predicted"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("failure")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = _loaded(held.value)
        for batch in batches:
            array = batch.column(vector)
            x, at = _matrix(array, weights.shape[1])
            scores = x @ weights.T + bias
            best, top, why = np.full(len(array), -1), np.full(len(array), np.nan), np.full(len(array), "no vector", object)
            why[np.asarray(array.is_valid())] = "not a vector of the model's length with finite components"
            best[at], top[at], why[at] = scores.argmax(axis=1), scores.max(axis=1), None
            none = best < 0
            made = [pa.array(best.astype(np.int32), mask=none), pa.array(top, mask=none), pa.array(why.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "predicted", "score", "failure"])

    return df.mapInArrow(run, schema)


def chunk_gradients(df: DataFrame, model: bytes, chunk: Sequence[str], vector: str = "vector", label: str = "label") -> DataFrame:
    """(chunk, class, place, gradient): the mean gradient of the cross entropy of a softmax classifier over each chunk's rows.

    ``place`` counts the vector's components, the last one is the bias. A batch's part of a chunk is one matrix product; parts of
    a chunk that lie in several tasks are added up by a grouped shuffle, so a chunk may have a row or most of the table. Rows
    whose vector does not fit, or whose label is no class of the model, count nowhere; chunks of only such rows have no gradient.
    """
    chunk = list(chunk)
    held = df.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = _loaded(held.value)
        sums: dict[tuple, list] = {}

        def flushed() -> pa.RecordBatch:
            keys = list(sums)
            columns = [pa.array([k[i] for k in keys], batch_schema.field(c).type) for i, c in enumerate(chunk)]
            flat = [(s[0] if s[0].ndim == 1 else s[0].ravel()).tolist() for s in sums.values()]
            return pa.RecordBatch.from_arrays([*columns, pa.array([s[1] for s in sums.values()], pa.int64()), pa.array(flat, pa.list_(pa.float64()))], names=[*chunk, "n", "sums"])

        batch_schema = None
        for batch in batches:
            batch_schema = batch.schema
            x, at = _matrix(batch.column(vector), weights.shape[1])
            y = np.asarray(pa.compute.fill_null(pa.compute.cast(batch.column(label), pa.int64()), -1))[at]
            known = (y >= 0) & (y < len(weights))
            x, at, y = x[known], at[known], y[known]
            logits = x @ weights.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(x) else logits
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            wide = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            rows: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*(batch.column(c).take(pa.array(at)).to_pylist() for c in chunk), strict=True)):
                rows.setdefault(k, []).append(i)
            for k, mine in rows.items():
                grad = p[mine].T @ wide[mine]
                if k in sums:
                    sums[k][0] += grad
                    sums[k][1] += len(mine)
                else:
                    sums[k] = [grad, len(mine)]
            if len(sums) > 256:
                yield flushed()
                sums.clear()
        if sums:
            yield flushed()

    width = _loaded(model)[0].shape[1] + 1
    parts = df.select(*chunk, vector, label).mapInArrow(run, f"{fields}, n long, sums array<double>")
    each = parts.select(*chunk, "n", F.posexplode("sums").alias("at", "s")).groupBy(*chunk, "at").agg((F.sum("s") / F.sum("n")).alias("gradient"))
    return each.select(*chunk, F.floor(F.col("at") / width).cast("int").alias("class"), (F.col("at") % width).cast("int").alias("place"), "gradient")
