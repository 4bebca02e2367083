"""Interleaved document sequences: ordered text and media references from HTML, payloads resolved by digest.

Media are stored once for each digest, as 8-bit grey PNG images of 64 samples a row; a page's sequence keeps
text, references and captions in reading order, and a join by digest resolves what each reference stands for.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, texts, written

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "figure", "ul", "ol", "table", "body", "title", "header", "footer", "nav", "blockquote", "pre"}
_SILENT = {"script", "style", "template", "noscript"}
ITEM = "position int, kind string, text string, ref string, caption string"


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.parts: list[str] = []
        self.silent, self.figure, self.caption = 0, [], None

    def flush(self) -> None:
        if (text := "".join(self.parts)).strip():
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.parts = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCKS or tag == "figcaption":
            self.flush()
        if tag == "figure":
            self.figure.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source", "embed") and (src := dict(attrs).get("src")):
            self.flush()
            self.items.append({"kind": "media", "text": None, "ref": src, "caption": dict(attrs).get("alt")})

    def handle_endtag(self, tag) -> None:
        if tag in _SILENT and self.silent:
            self.silent -= 1
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure[-1] if self.figure else len(self.items) :]:
                if item["kind"] == "media":
                    item["caption"] = text
        elif tag == "figure" and self.figure:
            self.flush()
            self.figure.pop()
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.parts.append(data)


def parse(page: str) -> list[dict]:
    """Text and media of a page in reading order, numbered from 0.  A figure's caption belongs to each of its media."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    if reader.caption is not None:
        reader.handle_endtag("figcaption")
    reader.flush()
    return [{"position": k, **item} for k, item in enumerate(reader.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, items array<struct>) of every page; null or empty HTML has no item, broken HTML what could be read."""
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [parse(t.decode("utf-8", "replace")) for t in texts(batch, "html")]
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(found, item)], ["id", "items"])

    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    return map_batches(src, run, f"id long, items array<struct<{ITEM.replace(' ', ': ').replace(',: ', ', ')}>>").withColumnRenamed("id", id_col)


def references(sequence: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, position, ref, caption) of each media item."""
    return sequence.select(id_col, F.explode("items").alias("i")).filter("i.kind = 'media'").select(id_col, "i.position", "i.ref", "i.caption")


def payload(text: bytes) -> bytes:
    """A text with bytes 0 up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """8-bit grey samples, WIDTH a row, unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """Samples of an image that to_png wrote; every checksum is verified."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, width, height, packed = 8, 0, 0, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def media_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(ref, media): each whole text's payload as an image under the digest of the payload; once a batch for equal texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made: dict[str, bytes] = {}
        for t in texts(batch):
            data = payload(t)
            ref = "sha256:" + hashlib.sha256(data).hexdigest()
            if ref not in made:
                made[ref] = to_png(data)
        return pa.RecordBatch.from_arrays([pa.array(list(made)), pa.array(list(made.values()), pa.binary())], ["ref", "media"])

    return map_batches(docs.select(F.col(text_col).cast("string").alias("text")), run, "ref string, media binary")


def media_features(store: DataFrame) -> DataFrame:
    """One row for each ref, from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for ref, media in zip(column(batch, "ref").to_pylist(), column(batch, "media").to_pylist()):
            data = from_png(media)
            x = np.frombuffer(data, np.uint8)
            levels = np.bincount(x >> 5, minlength=8)
            feature = f"{WIDTH}x{len(data) // WIDTH};mean={x.mean():.4f};std={x.std():.4f};levels={','.join(map(str, levels.tolist()))}"
            out.append((ref, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["ref", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "ref string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = map_batches(store, run, schema)
    rest = [c for c in rows.columns if c != "ref"]
    return rows.groupBy("ref").agg(F.min(F.struct(*rest)).alias("m")).select("ref", "m.*")


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """refs with what the store has of each, by digest; an unknown ref keeps its row, with nulls."""
    return refs.join(store, "ref", "left")


_PAGE = re.compile(r"\r\n?")


def page_of(text: str, ref: str, size: int) -> str:
    """A document as a page: its text, then the figure that refers to its payload."""
    body = html.escape(_PAGE.sub(lambda m: "".join(f"&#{ord(c)};" for c in m[0]), text).replace("\0", "�"), quote=False)
    return f'<article><p>{body}</p><figure><img src="{ref}" alt=""><figcaption>{size} bytes</figcaption></figure></article>'


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as an interleaved sequence whose media reference is resolved: id, n_bytes, the features of its media
    (see media_features), and caption, position of the reference.

    Null texts are empty; an empty text's payload is WIDTH zeros; equal texts refer to one medium.
    """
    store = written(media_store(docs, text_col), "media")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, t in zip(column(batch, "id").to_pylist(), texts(batch)):
            page = page_of(t.decode("utf-8", "replace"), "sha256:" + hashlib.sha256(payload(t)).hexdigest(), len(t))
            item = next(x for x in parse(page) if x["kind"] == "media")
            out.append((i, len(t), item["ref"], item["position"], item["caption"]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "n_bytes", "ref", "position", "caption"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    refs = map_batches(src, run, "id long, n_bytes long, ref string, position int, caption string")
    # a payload that a third of all documents share is split by the adaptive skew join
    return resolve(refs, media_features(store)).withColumnRenamed("id", id_col)
