"""Media columns: interleaved sequences of text and media references, with payloads found by digest."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, stored

#: Payload bytes are the samples of a grey image 24 wide, so a payload is a multiple of 24 * 24.
UNIT, WIDTH, FILL = 576, 24, 255
#: Parts in which the items of a digest that very many share are joined.
SALTS = 32
ITEM = "struct<position:int, kind:string, text:string, ref:string, caption:string>"
MEDIA = "digest string, media binary, n_bytes long"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
SKIPPED = {"script", "style", "head", "nav", "footer"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "tr", "table", "blockquote"}
MEDIA_TAGS = {"img", "video", "audio", "source", "embed"}


def to_payload(data: bytes) -> bytes:
    """data and bytes of 255 up to a positive multiple of 576."""
    return data + bytes([FILL]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def to_media(payload: bytes) -> bytes:
    """The payload as a binary grey map (PGM, P5): one 8-bit sample for each byte, so nothing is lost."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> bytes:
    """The samples of a stored image, checked against its header."""
    kind, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not a grey map of 8-bit samples")
    return samples


def feature_of(samples: bytes) -> str:
    """Mean, entropy in bits, and the mean of each quarter of the samples."""
    x = np.frombuffer(samples, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    quarters = (q.mean() for q in np.array_split(x, 4))
    return f"mean={x.mean():.6f};entropy={-(p * np.log2(p)).sum():.6f};quarters=" + ",".join(f"{q:.4f}" for q in quarters)


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skipped, self.caption = 0, None

    def flush(self):
        text, self.words = " ".join("".join(self.words).split()), []
        if text and self.caption is not None:
            self.items[self.caption]["caption"] = text
        elif text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped += 1
        if tag in BREAKS or tag in MEDIA_TAGS:
            self.flush()
        a = dict(attrs)
        if tag in MEDIA_TAGS and a.get("src") and not self.skipped:
            self.items.append({"kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt") or None})
        if tag == "figcaption":
            self.caption = next((i for i in range(len(self.items) - 1, -1, -1) if self.items[i]["kind"] == "media"), None)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        if tag in BREAKS:
            self.flush()
        if tag == "figcaption":
            self.caption = None

    def handle_data(self, data):
        if not self.skipped:
            self.words.append(data)


def parse_sequence(page: str | None) -> list[dict]:
    """The ordered texts and media references of a page; positions count from 0. A figcaption is the caption of the
    medium before it, else its alt text is. Null, empty and broken pages give what can be read of them."""
    p = _Sequence()
    p.feed(page or "")
    p.close()
    p.flush()
    return [{"position": i, **x} for i, x in enumerate(p.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, items): each page's sequence. Repeated rows give repeated sequences."""

    def run(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "caption"))]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(parse_sequence, part.column(1).to_pylist()), kind)], ["id", "items"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"id long, items array<{ITEM}>")


def media_table(data: DataFrame, column: str = "data") -> DataFrame:
    """(digest, media, n_bytes) of each row's bytes, padded and stored as an image; digest is the payload's SHA-256.
    Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            got, size = [], 0
            for x in b.column(0):
                raw = x.as_py() or b""
                payload = to_payload(raw)
                got.append((hashlib.sha256(payload).hexdigest(), to_media(payload), len(raw)))
                size += len(payload)
                if size > 1 << 23:
                    yield _rows(got)
                    got, size = [], 0
            yield _rows(got)

    def _rows(got):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.binary()), pa.array([x[2] for x in got], pa.int64())], ["digest", "media", "n_bytes"])

    return data.select(F.col(column).cast("binary").alias("data")).mapInArrow(run, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes, read back, hold: one row for each row of (digest, media, n_bytes). A medium whose samples
    don't have its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = []
            for digest, stored, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                stored = stored.as_py()
                back = from_media(stored)
                sha = hashlib.sha256(back).hexdigest()
                if sha != digest:
                    raise ValueError(f"stored medium {digest} reads back as {sha}")
                out.append((digest, n, len(back), sha, zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(back)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

    return media.select("digest", "media", "n_bytes").mapInArrow(run, FEATURES)


def resolved(seqs: DataFrame, media: DataFrame, *columns: str, prefix: str = "media:", key: str = "digest") -> DataFrame:
    """(id, position, kind, text, ref, caption, found, *columns): the items of all sequences in their positions, with
    columns of the medium that a reference of the form prefix + digest names.

    Items keep their order, number and captions: texts and references to nothing stay, with found false; a page without
    items is one row of nulls. media may repeat a digest; one row of each is taken (equal digests mean equal payloads). Only
    the columns asked for are moved, so payloads travel only if wanted. Media that very many items share are joined in
    SALTS parts: digests with a HOT_KEYS-th of all references (so many at most, whatever the size) have a row in each, and
    their items are dealt over them; so no task has all items of a digest. Columns of media called like an item's are
    refused.
    """
    taken = {"id", "position", "kind", "text", "ref", "caption", "found"} & set(columns)
    if taken:
        raise ValueError(f"columns of items: {sorted(taken)}")
    items = seqs.select("id", F.explode_outer("items").alias("i")).select("id", "i.*").withColumn("__digest", F.when(F.col("ref").startswith(prefix), F.substring("ref", len(prefix) + 1, 1 << 20)))
    items, _ = stored(items, "items")
    named = items.filter("__digest is not null")
    total = named.count()
    often = [r[0] for r in named.groupBy("__digest").count().filter(F.col("count") * HOT_KEYS >= max(total, HOT_KEYS * SALTS)).collect()]  # at most HOT_KEYS digests
    one = media.groupBy(F.col(key).alias("__digest")).agg(F.lit(True).alias("found"), *(F.first(c).alias(c) for c in columns))
    salt = F.lit(0)
    if often:
        one = one.withColumn("__salt", F.explode(F.when(F.col("__digest").isin(often), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        salt = F.when(F.col("__digest").isin(often), F.pmod(F.xxhash64("id", "position"), F.lit(SALTS)).cast("int")).otherwise(0)
    else:
        one = one.withColumn("__salt", F.lit(0))
    joined = items.withColumn("__salt", salt).join(one, ["__digest", "__salt"], "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False))).drop("__digest", "__salt")


def document_page(digest: Column, doc_id: Column) -> Column:
    """A page that shows a document's payload: a heading, its image and the caption that names the document."""
    return F.concat(F.lit("<h1>document</h1><figure><img src='media:"), digest, F.lit("'><figcaption>document "), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("</figcaption></figure>"))


__all__ = ["document_page", "feature_of", "from_media", "media_features", "media_table", "parse_sequence", "resolved", "sequences", "to_media", "to_payload"]
