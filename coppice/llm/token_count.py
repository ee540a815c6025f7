"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

A text of up to ``huge`` characters is cut at white space, which this kind of
vocabulary never lets a token cross; the pieces are encoded by the library once
per distinct piece and counted from a bounded table. A longer text is encoded in
overlapping chunks with offsets. Two neighbouring chunks are joined at a common
boundary that is proven stable: a character position right after white space,
where both chunks start a token, with equal (id, start, end) for every token
from there to the last white space inside the overlap. Without such a position
the overlap is widened; at last the rest is encoded in one go.

Null and empty texts have 0 tokens. Rows are independent, so repeated rows and
empty tables need nothing special. Extra columns are kept, whatever their names;
``n_bytes`` and ``n_tokens`` give way to the operator's own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import guarded

#: Characters of pieces that the table of counted pieces may hold.
KNOWN_CHARS = 1 << 24
#: White space for str.split() that the vocabulary's own pattern does not call white space.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def aligned(left: list[tuple], right: list[tuple], text: str, start: int, end: int) -> int | None:
    """A character position in [start, end) where the tokens of two chunks can be joined, or None.

    ``right`` begins at ``start`` and ``left`` ends at ``end``; both hold (id, start, end) tuples in
    the text's own offsets. Tokens after the last white space before ``end`` may differ, as the left
    chunk was cut there.
    """
    stop = end
    while stop > start and not text[stop - 1].isspace():
        stop -= 1
    a = [t for t in left if start <= t[1] < stop]
    b = [t for t in right if start <= t[1] < stop]
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    safe = [t[1] for t in b[len(b) - n :] if t[1] > start and text[t[1] - 1].isspace() and text[t[1] - 1] not in ODD_SPACE]
    return safe[len(safe) // 2] if safe else None


def spliced(text: str, encode, chunk: int, overlap: int) -> list[int]:
    """Token ids of a text by overlapping chunks. ``encode(str)`` gives (ids, offsets)."""

    def tokens(start: int, end: int) -> list[tuple]:
        ids, offsets = encode(text[start:end])
        return [(i, start + a, start + b) for i, (a, b) in zip(ids, offsets, strict=True)]

    done: list[int] = []
    start, end = 0, min(len(text), chunk)
    left = tokens(start, end)
    while end < len(text):
        wide, at = overlap, None
        while at is None and wide < end - start:
            after = min(len(text), end - wide + chunk)
            if after <= end:  # the overlap leaves no room for anything new
                after = min(len(text), end + chunk)
            right = tokens(end - wide, after)
            at = aligned(left, right, text, end - wide, end)
            if at is None:
                wide *= 2
        if at is None:  # no stable boundary in the whole chunk: make the chunk itself larger
            end = min(len(text), end + (end - start))
            left = tokens(start, end)
            continue
        done += [t[0] for t in left if t[1] < at]
        left = [t for t in right if t[1] >= at]
        start, end = at, after
    return done + [t[0] for t in left]


def token_counts(docs: DataFrame, model: str, text: str = "text", huge: int = 1 << 14, chunk: int = 1 << 13, overlap: int = 1 << 9, known: int = 400_000) -> DataFrame:
    """``docs`` without ``text`` plus ``n_bytes`` and ``n_tokens``; ``model`` is the content of a tokenizer's JSON file.

    ``known`` bounds the table of pieces already counted.
    """
    return guarded(docs, (text,), lambda d: _token_counts(d, model, text, huge, chunk, overlap, known))


def _token_counts(docs: DataFrame, model: str, text: str, huge: int, chunk: int, overlap: int, known: int) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        counts: dict[str, int] = {}
        held = 0

        def encode(part: str):
            out = tokenizer.encode(part, add_special_tokens=False)
            return out.ids, out.offsets

        def whole(part: str) -> int:
            return len(spliced(part, encode, chunk, overlap) if len(part) > huge else encode(part)[0])

        for batch in batches:
            texts = batch.column(text).to_pylist()
            words: list[list[str] | None] = [None] * len(texts)
            out = [0] * len(texts)
            for begin in range(0, len(texts), 256):
                part = range(begin, min(begin + 256, len(texts)))
                for i in part:
                    x = texts[i] or ""
                    if len(x) > huge or any(c in x for c in ODD_SPACE):
                        out[i] = whole(x)
                    else:
                        words[i] = x.split()
                if len(counts) > known or held > KNOWN_CHARS:
                    counts.clear()
                    held = 0
                new = list({w for i in part if words[i] for w in words[i]}.difference(counts))
                held += sum(map(len, new))
                for w, e in zip(new, tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                    counts[w] = len(e)
                for i in part:
                    if words[i] is not None:
                        out[i] = sum(map(counts.__getitem__, words[i]))
                        words[i] = None
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n_bytes, pa.array(out, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def model_text(path: str) -> str:
    """A tokenizer's JSON file as text, checked to be one whose tokens never cross white space."""
    with open(path, encoding="utf-8") as f:
        out = f.read()
    spec = json.loads(out)
    split = json.dumps(spec.get("pre_tokenizer") or {})
    if '"Removed"' not in split or "[^\\\\s" not in split:
        raise ValueError("this counter needs a pre-tokenizer that drops white space")
    return out
