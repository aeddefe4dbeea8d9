"""Media columns: interleaved document sequences.

`parse_sequences` turns HTML into ordered structs: a run of text, or a media reference with its caption
(the figure's figcaption wherever it stands in the figure, else the alt text). `resolve` joins references
with a media table by digest; positions and captions stay with their references, so the order is that of
the page. Media are stored as 8-bit greyscale PNG, 64 samples a row: any bytes whose length is a positive
multiple of 64. `render_pages` lays a text out as a page, its lines as paragraphs around its media.

The digest join never carries payloads: what is asked of a payload is computed where it is stored, once
a digest, and only those columns meet the references (hot digests by broadcast, see skew_join).
`outline` replaces texts by their length and digest where a join need not carry them either.

Defined cases: null or empty HTML gives an empty sequence; a reference without stored media stays, with
null columns, and null or equal ids are told apart by their sequences; a figcaption in a figure without
media is text; an empty payload is stored as one row of zeros; equal payloads share a digest.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, keyed_text, skew_join, strings, table, texts

ROW = 64
_PNG = b"\x89PNG\r\n\x1a\n"
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))
MEDIA = frozenset(("img", "audio", "video", "source"))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 5) -> bytes:
    """Greyscale, 8 bits a sample, 64 samples a row, no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of what to_png wrote; ValueError on a broken file."""
    if data[:8] != _PNG:
        raise ValueError("no PNG")
    at, packed, height = 8, [], 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's CRC is wrong")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if (width, *rest) != (ROW, 8, 0, 0, 0, 0):
                raise ValueError("not of this store's form")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("a row is filtered")
    return lines[:, 1:].tobytes()


class _Sequence(HTMLParser):
    """Collects text and media in page order; a figure's caption is given out when the figure ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.hidden, self.caption = 0, None
        self.figures: list[dict] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag in MEDIA:
            got = dict(attrs)
            if got.get("src"):
                self.flush()
                self.out.append({"kind": "media", "text": None, "ref": got["src"].removeprefix("sha256:"), "caption": got.get("alt")})
                if self.figures:
                    self.figures[-1]["media"].append(self.out[-1])
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append({"media": [], "captions": []})
            elif tag == "figcaption":
                self.caption = []

    def handle_endtag(self, tag) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag == "figcaption":
            self.end_caption()
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_figure()

    def end_caption(self) -> None:
        if self.caption is None:
            return
        self.flush()
        self.text, self.caption = self.caption, None
        before = len(self.out)
        self.flush()  # as a text for now
        if self.figures:
            self.figures[-1]["captions"] += self.out[before:]

    def end_figure(self) -> None:
        self.end_caption()
        if self.figures and (done := self.figures.pop())["media"] and done["captions"]:
            told = {id(x) for x in done["captions"]}
            self.out = [x for x in self.out if id(x) not in told]
            for x in done["media"]:
                x["caption"] = " ".join(c["text"] for c in done["captions"])

    def close(self) -> None:
        super().close()
        self.flush()
        while self.figures or self.caption is not None:
            self.end_figure()

    def handle_data(self, data) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(page: str) -> list[dict]:
    """Ordered structs (pos, kind, text, ref, caption) of a page."""
    p = _Sequence()
    p.feed(page)
    p.close()
    return [{"pos": i, **x} for i, x in enumerate(p.out)]


_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
_ITEM_SQL = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


def parse_sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns to keep, items): the page's interleaved sequence."""
    rows = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).cast("string").alias("html"), *keep)
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array([sequence(x) for x in strings(b)], pa.list_(_ITEM))], names=["doc_id", *keep, "items"])

    return rows.mapInArrow(run, "doc_id long, " + "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep) + f"items {_ITEM_SQL}")


def outline(sequences: DataFrame) -> DataFrame:
    """Sequences whose texts are replaced by their length and digest."""
    brief = lambda t: F.concat_ws(":", F.length(t), F.substring(F.sha2(t, 256), 1, 16))
    return sequences.withColumn("items", F.transform("items", lambda i: i.withField("text", F.when(i["text"].isNotNull(), brief(i["text"])))))


def store_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, media): each text's padded bytes as PNG under their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                payloads = [padded(x) for x in texts(batch.slice(at, 500), 0)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([to_png(p) for p in payloads], pa.binary())], names=["digest", "media"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "digest string, media binary")


def page(text: bytes) -> str:
    """A text as HTML: its lines as paragraphs, and behind the first one a figure with its stored media."""
    payload = padded(text)
    lines = [f"<p>{htmllib.escape(x)}</p>" for x in text.decode().split("\n") if x.strip()]
    figure = f'<figure><img src="sha256:{hashlib.sha256(payload).hexdigest()}"><figcaption>{len(text)} of {len(payload)} bytes</figcaption></figure>'
    return "".join(["<article>", *lines[:1], figure, *lines[1:], "</article>"])


def render_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, html): each document as a page that interleaves its text and its media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                data = texts(b)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([page(x) for x in data], pa.string())], names=["doc_id", "n_bytes", "html"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, html string")


PROPERTIES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, look string"


def media_properties(media: DataFrame, digest_col: str = "digest", media_col: str = "media") -> DataFrame:
    """One row a digest: sizes, digests and a summary of the samples, all from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload = from_png(data)
                seen = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                look = f"64x{len(payload) // ROW} L8 sum={int(seen @ np.arange(256))} distinct={int((seen > 0).sum())} mode={int(seen.argmax())}"
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), look))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in PROPERTIES.split(", ")])

    each = media.select(digest_col, media_col).mapInArrow(run, PROPERTIES)
    names = [c for c in each.columns if c != "digest"]
    return each.groupBy("digest").agg(F.first(F.struct(*names)).alias("p")).select("digest", "p.*")


def resolve(sequences: DataFrame, properties: DataFrame) -> DataFrame:
    """Sequences with each reference's media columns, in page order; unresolved references and texts have null
    there. Documents without items keep their row (empty), as do all other columns."""
    # rows with one id and equal items get equal media, so the two name a row
    rows = sequences.withColumn("_mark", F.xxhash64("items"))
    refs = rows.select("doc_id", "_mark", F.explode("items").alias("i")).where("i.ref IS NOT NULL").select("doc_id", "_mark", F.col("i.ref").alias("digest"))
    names = [c for c in properties.columns if c != "digest"]
    found = skew_join(refs, properties, "digest").groupBy(F.col("doc_id").alias("_id"), F.col("_mark").alias("_row"))
    found = found.agg(F.map_from_entries(F.collect_set(F.struct("digest", F.struct(*names)))).alias("_media"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["_mark"] == found["_row"]), "left")
    items = F.transform("items", lambda i: F.struct(*(i[c].alias(c) for c in ("pos", "kind", "text", "ref", "caption")), F.element_at("_media", i["ref"]).alias("media")))
    return out.select(*(c for c in sequences.columns if c != "items"), items.alias("items"))


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "media"), table(spark, sf_dir, "documents")
    properties = scratch.write(media_properties(scratch.write(store_media(docs), "stored")), "properties")
    scratch.drop("stored")
    sequences = scratch.write(outline(parse_sequences(render_pages(docs), "doc_id", "html", ("n_bytes",))), "sequences")
    found = resolve(sequences, properties).withColumn("m", F.filter("items", lambda i: i["kind"] == "media")[0])
    texts_seen = F.concat_ws(",", F.transform("items", lambda i: i["text"]))
    return found.select(
        "doc_id", "n_bytes", "m.media.payload_bytes", "m.media.payload_sha256", "m.media.tail_crc32", "m.media.media_bytes", "m.media.media_sha256",
        F.concat_ws(" ", F.lit("at"), "m.pos", F.lit("of"), F.size("items"), "m.media.look", "m.caption", F.substring(F.sha2(texts_seen, 256), 1, 16)).alias("feature"),
    )
