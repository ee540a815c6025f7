"""Language identification by a bidirectional gated recurrent network over bytes.

The gates' curve is v / (1 + |v|), moved to 0..1, and the candidate's the same
from -1 to 1. The network is trained here, in numpy, by backpropagation through time: every
byte of a training window is labelled with its document's language. To predict,
the whole text is cut into windows of ``WINDOW`` bytes, the network gives every
position a probability per language, and a document's probabilities are the mean
over its positions.

The fit uses a bounded sample: of each of the ``LANGS`` most frequent languages
about ``PER_LANG`` documents with the least hash of id and text (equal rows count
once), and of each document at most ``PARTS`` parts of ``PART`` bytes, spread evenly from its
beginning to its end. Prediction covers all bytes of all rows. A null text, or
one without a letter, is ``und`` with score 0; so is every text if there was no
labelled row to learn from. Rows are independent, so repeated rows and empty
tables need nothing special; a text may be of any length. Extra columns are kept,
whatever their names; ``lang_pred`` and ``score`` give way to the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, guarded, picked

WINDOW = 64
HIDDEN = 8
PER_LANG = 600
#: Languages that are learned at most, the most frequent ones.
LANGS = 1000
#: Parts of a sampled document that training windows are drawn from, and their bytes; a shorter document is taken whole.
PARTS, PART = 16, 1024


@dataclass
class Network:
    """Per direction: input table (256, 3H), recurrent weights (H, 3H), candidate bias (H); then the output layer."""

    langs: list[str]
    params: dict[str, np.ndarray]


def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        p[f"U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        p[f"c{d}"] = np.zeros(hidden, np.float32)
        p[f"W{d}"] = rng.normal(0, 0.3, (hidden, len(langs))).astype(np.float32)
    p["b"] = np.zeros(len(langs), np.float32)
    return Network(langs, p)


def forward(x: np.ndarray, p: dict[str, np.ndarray], d: str, keep: list | None = None) -> np.ndarray:
    """States (T, H, B) of one direction over bytes (T, B); ``keep`` gathers what going back needs.

    Windows lie along the last axis, so that every elementwise step runs over long rows.
    """
    table, u, c = p[f"E{d}"], np.ascontiguousarray(p[f"U{d}"].T), p[f"c{d}"][:, None]
    n, (steps, rows) = u.shape[1], x.shape
    h = np.zeros((n, rows), np.float32)
    out = np.empty((steps, n, rows), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a, g = np.take(table, x[t], axis=0, mode="clip").T, u @ h
        gates = g[: 2 * n]
        gates += a[: 2 * n]
        squashed(gates)
        gates += 1.0
        gates *= 0.5
        z, r = gates[:n], gates[n:]
        m = g[2 * n :]
        m += c
        cand = m * r
        cand += a[2 * n :]
        squashed(cand)
        if keep is not None:
            keep.append((t, h, z, r, m, cand))
        h = np.subtract(h, cand, out=out[t])
        h *= z
        h += cand
    return out


def squashed(v: np.ndarray) -> None:
    """v / (1 + |v|) in place: a cheap curve from -1 to 1; its slope is (1 - |result|) squared."""
    low = np.abs(v)
    low += 1.0
    v /= low


def back(x: np.ndarray, p: dict[str, np.ndarray], d: str, keep: list, dout: np.ndarray, grad: dict[str, np.ndarray]) -> None:
    """Backpropagation through time of one direction; dout (T, H, B): the loss's gradient by the states."""
    u = p[f"U{d}"]
    dh = np.zeros_like(keep[0][1])
    for t, h, z, r, m, cand in reversed(keep):
        dh = dh + dout[t]
        dz = dh * (h - cand) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        da = dh * (1 - z) * (1 - np.abs(cand)) ** 2
        dr = da * m * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        dm = da * r
        dg = np.concatenate([dz, dr, dm])
        grad[f"U{d}"] += h @ dg.T
        grad[f"c{d}"] += dm.sum(axis=1)
        np.add.at(grad[f"E{d}"], x[t], np.concatenate([dz, dr, da]).T)
        dh = dh * z + u @ dg


def probabilities(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """(T, languages, B) of each position."""
    logits = p["Wf"].T @ forward(x, p, "f")
    logits += p["Wb"].T @ forward(x, p, "b")
    logits += p["b"][:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def train(texts: list[bytes], langs: list[str], steps: int = 260, rows: int = 192, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam on windows drawn evenly from the languages."""
    names = sorted({x for x, t in zip(langs, texts, strict=True) if t})
    if not names:
        return Network([], {})
    net, rng = fresh(names, seed=seed), np.random.default_rng(seed)
    p = net.params
    by = [[np.frombuffer(t, np.uint8) for t, x in zip(texts, langs, strict=True) if x == name and t] for name in names]
    weights = [np.array([len(t) for t in group], float) for group in by]
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(len(names), size=rows)
        x, mask = np.zeros((WINDOW, rows), np.uint8), np.zeros((WINDOW, 1, rows), np.float32)
        for i, c in enumerate(y):
            t = by[c][rng.choice(len(by[c]), p=weights[c] / weights[c].sum())]
            at = rng.integers(max(1, len(t) - WINDOW + 1))
            part = t[at : at + WINDOW]
            x[: len(part), i], mask[: len(part), 0, i] = part, 1
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: forward(x, p, d, kept[d]) for d in "fb"}
        logits = p["Wf"].T @ states["f"] + p["Wb"].T @ states["b"] + p["b"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        prob[:, y, np.arange(rows)] -= 1
        delta = prob * mask / mask.sum()
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["b"] = delta.sum(axis=(0, 2))
        for d in "fb":
            grad[f"W{d}"] = np.tensordot(states[d], delta, axes=([0, 2], [0, 2]))
            back(x, p, d, kept[d], p[f"W{d}"] @ delta, grad)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            p[k] = (p[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(raw: np.ndarray, offsets: np.ndarray, net: Network, rows: int = 2048) -> np.ndarray:
    """Mean probability per language of each text; texts lie end to end."""
    sizes = np.diff(offsets)
    parts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), parts)
    first = np.cumsum(parts) - parts
    start = offsets[owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    length = np.minimum(offsets[owner + 1] - start, WINDOW) if len(owner) else start
    out = np.zeros((len(sizes), len(net.langs)))
    steps = np.arange(WINDOW)
    for k in range(0, len(owner), rows):
        s, n = start[k : k + rows], length[k : k + rows]
        inside = steps[:, None] < n
        x = np.where(inside, raw[np.minimum(s + steps[:, None], len(raw) - 1)], 0)
        prob = probabilities(x, net.params)
        prob *= inside[:, None, :]
        np.add.at(out, owner[k : k + rows], prob.sum(axis=0).T)
    return out / np.maximum(sizes, 1)[:, None]


def parts(raw: bytes) -> list[bytes]:
    """A document's text for training: whole, or in parts evenly spread over it."""
    if len(raw) <= PARTS * PART:
        return [raw]
    return [raw[a : a + PART] for a in (k * (len(raw) - PART) // (PARTS - 1) for k in range(PARTS))]


def sampled(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[bytes], list[str]]:
    """Texts (or their parts) and languages of a bounded number of documents (doc_id, text, lang) with a language."""
    docs = picked(docs, "doc_id", "text", "lang")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not totals:
        return [], []
    scale = 1_000_000
    limits = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(scale, -(-scale * per_lang // n)))])
    rows = known.where(F.pmod("_h", F.lit(scale)) < F.element_at(limits, F.col("lang"))).dropDuplicates(["_h", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([parts(v.as_buffer().to_pybytes()) for v in batch.column("text")], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("lang"), made], names=["_h", "lang", "parts"])

    got = rows.mapInArrow(run, "_h long, lang string, parts array<binary>").orderBy("_h", "lang").collect()
    return [bytes(x) for r in got for x in r["parts"]], [r["lang"] for r in got for _ in r["parts"]]


def predicted(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` plus ``lang_pred`` and ``score``."""
    return guarded(docs, (text,), lambda d: _predicted(d, net, text))


def _predicted(docs: DataFrame, net: Network, text: str) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, 1 << 20):
                texts = part.column(text)
                raw, offsets = flat(texts)
                if not net.langs:
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts))], names=[*keep, "lang_pred", "score"])
                    continue
                prob = pooled(raw, offsets, net)
                some = np.asarray(pa.compute.fill_null(pa.compute.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
                best = prob.argmax(axis=1)
                lang = np.where(some, np.array(net.langs, object)[best], "und")
                score = np.where(some, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, text).mapInArrow(run, schema)
