"""Media columns: interleaved document sequences whose media live in a table keyed by digest.

``sequences`` parses HTML into an ordered array of (position, kind, text, ref,
caption) structs; ``resolved`` explodes its media references and joins them by
digest with any media table (payloads, or descriptions of them), so that
position and caption stay beside the payload's columns. ``stored_image`` is a
lossless 8-bit form: a binary grey map, 64 samples wide. ``stored`` writes the
media table, one row per distinct digest, chosen by digests alone so that no
payload is shuffled; ``described`` reads the stored bytes back from it where
they lie, and only digests and descriptions are shuffled.

Null and empty texts are stored as 64 zero samples. Equal payloads have one row
in the media table, whichever rows they come from. An unresolved reference keeps
its row, with nulls. Null and empty pages have empty sequences; pages and
payloads may be of any length, empty tables give empty ones, and repeated rows
keep their own references. Extra columns are kept, whatever their names; one that
is called like a column of the result gives way.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html_tree
from .common import guarded, picked, small, written

WIDTH = 64
SCHEME = "sha256:"
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
HEADER = re.compile(rb"P5\s(\d+)\s(\d+)\s255\s")


def stored_image(text: Column) -> Column:
    """A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a binary grey map."""
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(WIDTH))).cast("int")
    header = F.encode(F.concat(F.lit(f"P5\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8")
    padding = F.lit(bytes(WIDTH)).substr(F.lit(1), rows * WIDTH - F.octet_length(raw).cast("int"))
    return F.concat(header, raw, padding)


def samples(stored: bytes) -> np.ndarray:
    """The samples of a stored grey map, read back."""
    head = HEADER.match(stored)
    width, height = int(head[1]), int(head[2])
    out = np.frombuffer(stored, np.uint8, offset=head.end())
    if out.size != width * height:
        raise ValueError("a grey map holds width times height samples")
    return out.reshape(height, width)


def feature(image: np.ndarray) -> str:
    """Height, sum, sum of squares and number of values of the samples: whole numbers, the same everywhere."""
    count = np.bincount(image.ravel(), minlength=256)
    level = np.arange(256)
    return f"h={image.shape[0]};sum={int(count @ level)};squares={int(count @ (level * level))};values={int((count > 0).sum())}"


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The stored forms of all texts, written: digest, stored bytes, and the row's place in the written table."""
    rows = picked(docs, text).select(stored_image(F.col(text)).alias("stored"))
    return written(rows.select(F.sha2("stored", 256).alias("digest"), "stored", F.monotonically_increasing_id().alias("place")))


def media_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of digest and stored bytes for each distinct text; which copy stands for all is settled by digests and places alone."""
    table = kept(docs, text)
    first = written(table.groupBy("digest").agg(F.min("place").alias("place")).select("place"))
    return table.join(small(first), "place", "left_semi").select("digest", "stored")


def described(media: DataFrame, stored: str = "stored") -> DataFrame:
    """One row per distinct stored form: digest, sizes, hashes and features of what is read back from it."""
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {}
            for value in batch.column(0):
                raw = value.as_buffer().to_pybytes()
                digest = hashlib.sha256(raw).hexdigest()
                if digest not in rows:
                    image = samples(raw)
                    payload = image.tobytes()
                    rows[digest] = (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), feature(image))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows.values(), strict=True) if rows else [[]] * 6, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return media.select(stored).mapInArrow(run, schema).dropDuplicates(["digest"])


def sequence(page: str | None) -> list[dict]:
    """Ordered text and media structs of one page; a figure's caption stands at its media, not as text."""
    out: list[dict] = []
    shown: dict = {}  # the last media of each figure
    around: dict = {None: (None, False)}  # an element's figure, and whether it is in a caption
    last = None

    def place(element) -> tuple:
        chain = []
        while element not in around:
            chain.append(element)
            element = element.parent
        figure, caption = around[element]
        for e in reversed(chain):
            figure, caption = (e, False) if e.name == "figure" else (figure, caption or (e.name == "figcaption" and figure is not None))
            around[e] = (figure, caption)
        return figure, caption

    for kind, element, block, value in html_tree.nodes(page or ""):
        figure, caption = place(element)
        if kind == "media":
            out.append({"kind": "media", "text": None, "ref": value.get("src") or value.get("data-src"), "caption": [value.get("alt") or ""]})
            if figure is not None:
                shown[figure] = out[-1]
            last = None
        elif caption:
            if figure in shown:
                shown[figure]["caption"].append(value)
        elif last == block and out and out[-1]["kind"] == "text":
            out[-1]["text"].append(value)
        else:
            out.append({"kind": "text", "text": [value], "ref": None, "caption": []})
            last = block
    rows = []
    for x in out:
        text = " ".join("".join(x["text"]).split()) if x["text"] else None
        if x["kind"] == "media" or text:
            rows.append({"position": len(rows), "kind": x["kind"], "text": text, "ref": x["ref"], "caption": " ".join(" ".join([x["caption"][0], "".join(x["caption"][1:])]).split()) or None if x["caption"] else None})
    return rows


def sequences(pages: DataFrame, html: str = "html", into: str = "sequence") -> DataFrame:
    """``pages`` without ``html`` plus the ordered array of text and media structs."""
    return guarded(pages, (html,), lambda d: _sequences(d, html, into))


def _sequences(pages: DataFrame, html: str, into: str) -> DataFrame:
    keep = [c for c in pages.columns if c != html]
    schema = pages.select(*keep, F.lit(None).cast(SEQUENCE).alias(into)).schema
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([sequence(x) for x in batch.column(html).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], names=[*keep, into])

    return pages.select(*keep, html).mapInArrow(run, schema)


def resolved(rows: DataFrame, media: DataFrame, into: str = "sequence") -> DataFrame:
    """One row per media reference: the row's other columns, position, caption, digest and the media's columns.

    ``media`` has one row per ``digest`` and is best a written table: then either side of the join is dealt by
    digest for the join alone, and adaptive execution can split a digest that very many rows refer to.
    """

    def joined(d: DataFrame) -> DataFrame:
        keep = [c for c in d.columns if c != into]
        refs = d.select(*keep, F.explode(F.filter(into, lambda x: x["kind"] == "media")).alias("_item"))
        refs = refs.select(*keep, F.col("_item.position").alias("position"), F.col("_item.caption").alias("caption"), F.regexp_replace("_item.ref", f"^{SCHEME}", "").alias("digest"))
        return refs.join(media, "digest", "left")

    return guarded(rows, (into,), joined)


def illustrated(text: Column, digest: Column, caption: Column) -> Column:
    """A text as a page: a paragraph for each line, and after the first one a figure that refers to a digest."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(escaped, "\n")
    figure = F.concat(F.lit("<figure><img src='" + SCHEME), digest, F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure>"))
    rest = F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    return F.concat(F.lit("<article><p>"), lines[0], F.lit("</p>"), figure, F.concat_ws("", rest), F.lit("</article>"))
