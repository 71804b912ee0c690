"""WARC archives: write pages as records, read them back by boundary chains.

Writing. Pages with equal payloads of at least ``min_bytes`` bytes share one
response record, that of the largest page_id; the others become revisit
records without a block. Records go through Spark's text writer with the
record end (CRLF CRLF) as line separator, so an archive is a plain WARC file
on any file system Spark knows.

Reading. The text reader cuts the archives at the magic ``WARC/1.1`` CRLF,
wherever it stands and however the files are split, and the sizes of the cut
pieces give every piece its offset. Tasks emit for each piece the offset of
the candidate record and, from its header, that of its successor. A magic
inside a payload is a candidate too. Pointer jumping follows the successors
from offset 0 of each file: first inside each split (from every candidate to
where its chain leaves the split), then over the splits, doubling the jump each
round; only candidates on that chain are records. Pieces that belong to a
payload with a magic inside are read again and joined to their record.

Defined results: a null html is an empty payload; empty payloads count as
equal when ``min_bytes`` is 0; line breaks and blanks in a url are written as
%XX; a null url leaves the header field out; rows with a null page_id are
written as responses of their own; a repeated page_id is a record per row and
each is judged by its own payload (equal rows are alike: all responses or all
revisits); payloads of any length are whole; extra columns of any name are
ignored; an empty table gives empty archives and an empty result.
A chain that breaks (a damaged file) ends there, later records are not kept.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowscore.llm.common import pick, written
from flowscore.session import scratch_path

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
MIN_BYTES = 0
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELD = re.compile(rb"^([A-Za-z-]+): *(.*?)\r?$", re.M)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    head = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(),
            b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha1:" + digest(payload).encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20]", lambda m: b"%%%02X" % m[0][0], url.encode()))
    if refers_to is None:
        head += [b"Content-Type: text/html", b"Content-Length: %d" % len(payload)]
    else:
        head += [b"WARC-Profile: " + REVISIT.encode(), b"WARC-Refers-To: <urn:page:%d>" % refers_to,
                 b"X-Payload-Length: %d" % len(payload), b"Content-Length: 0"]
    return MAGIC + b"\r\n".join(head) + END + (payload if refers_to is None else b"")


def _records(date):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                out = [_record(p, u, (h or "").encode(), r, date) for p, u, h, r in zip(*[s.column(c).to_pylist() for c in
                                                                                       ("page_id", "url", "html", "refers_to")])]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    return run


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = MIN_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``, one file per task."""
    pages = pick(pages, "page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    payload = {"sum": F.sha1(html.cast("binary")), "n": F.octet_length(html)}
    sums = written(pages.select("page_id", *[v.alias(k) for k, v in payload.items()]).filter(
        (F.col("n") >= min_bytes) & F.col("page_id").isNotNull()), "warc-sums")
    first = written(sums.groupBy("sum", "n").agg(F.max("page_id").alias("last"), F.min("page_id").alias("least")).filter(
        "last <> least").drop("least"), "warc-equal")
    # a row is its page_id and payload: rows of one page_id may hold different payloads
    again = written(sums.join(first, ["sum", "n"]).filter("page_id <> last").select(
        "page_id", "sum", "n", F.col("last").alias("refers_to")).distinct(), "warc-revisits")
    rows = pages.withColumns(payload).join(again, ["page_id", "sum", "n"], "left").select("page_id", "url", "html", "refers_to")
    rows.mapInArrow(_records(date), "value binary").select(F.col("value").cast("string")).write.option(
        "lineSep", END.decode()).text(path)


def _pieces(with_bytes):
    """Per piece of a split, in order: its place in the split, its size, what its header says.

    Offsets count from the first byte the split owns; the piece's own magic
    stands before it. The payload's digest is there if the piece holds all of it.
    """
    names = ["file", "block", "off", "size", "head", "length", "kind", "page_id", "refers_to", "sum", "full", *["value"] * with_bytes]

    def run(batches):
        place, at = None, 0
        for b in batches:
            cols = [[] for _ in names]
            held = 0
            for file, block, value in zip(b.column("file"), b.column("block"), b.column("value")):
                key = (file.as_py(), block.as_py())
                if key != place:
                    place, at = key, 0
                body = value.as_py()
                row = [*key, at, len(body), *_parsed(body)]
                at += len(body) + len(MAGIC)
                for c, v in zip(cols, row + [body] * with_bytes):
                    c.append(v)
                held += len(body) * with_bytes
                if held > 8 << 20:
                    yield _piece_batch(cols, names)
                    cols, held = [[] for _ in names], 0
            yield _piece_batch(cols, names)
    return run


def _parsed(body: bytes) -> list:
    """[header bytes, content length, type, page id, refers to, digest, whether the payload is whole]; no header: nulls."""
    end = body.find(END)
    fields = {k.lower(): v for k, v in FIELD.findall(body[:end])} if end >= 0 else {}
    kind, length = fields.get(b"warc-type"), fields.get(b"content-length", b"")
    if kind is None or not length.isdigit():
        return [None] * 6 + [False]
    n = int(length)

    def page(name):
        m = re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(name, b""))
        return int(m[1]) if m else None

    full = end + len(END) + n <= len(body)
    if kind == b"revisit":
        total = fields.get(b"x-payload-length", b"")
        return [end, n, "revisit:" + (total.decode() if total.isdigit() else ""), page(b"warc-record-id"), page(b"warc-refers-to"),
                fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:"), full]
    return [end, n, kind.decode("latin-1"), page(b"warc-record-id"), None, digest(body[end + len(END): end + len(END) + n]) if full else None, full]


TYPES = {"file": pa.string(), "block": pa.int64(), "off": pa.int64(), "size": pa.int64(), "head": pa.int64(), "length": pa.int64(), "kind": pa.string(),
         "page_id": pa.int64(), "refers_to": pa.int64(), "sum": pa.string(), "full": pa.bool_(), "value": pa.binary()}
SQL_TYPES = ("file string, block long, off long, size long, head long, length long, kind string, page_id long, refers_to long, "
             "sum string, full boolean")


def _piece_batch(cols, names):
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[n]) for c, n in zip(cols, names)], names=names)


def _scan(spark: SparkSession, path: str, with_bytes: bool) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("value").cast("binary").alias("value")).mapInArrow(_pieces(with_bytes), SQL_TYPES + ", value binary" * with_bytes)


def _leave(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per candidate of a split, where its chain leaves the split (pointer doubling on the split's own table)."""
    pdf = pdf.sort_values("at")
    at, succ = pdf["at"].to_numpy(), pdf["succ"].to_numpy().copy()
    while True:
        k = np.minimum(np.searchsorted(at, succ), len(at) - 1)
        inside = at[k] == succ
        if not inside.any():
            return pdf.assign(leaves=succ)
        succ = np.where(inside, succ[k], succ)


def _on_chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pieces of a split, with the record each belongs to: the chain from the split's entry is marked."""
    pdf = pdf.sort_values("at")
    at = pdf["at"].to_numpy()
    live = np.zeros(len(at), bool)
    x = int(pdf["entry"].iloc[0])
    succ = pdf["succ"].to_numpy()
    k = int(np.searchsorted(at, x))
    while k < len(at) and at[k] == x and succ[k] >= 0:
        live[k] = True
        x = succ[k]
        k = int(np.searchsorted(at, x))
    owner = np.maximum.accumulate(np.where(live, at, -1))
    return pdf[["file", "block", "at"]].assign(live=live, owner=owner)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record on the files' chains."""
    piece = written(_scan(spark, path, False), "warc-pieces")
    # the offset of a split's first piece: the bytes of all pieces before it in the file
    per = piece.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = written(per.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "warc-splits")
    start = F.col("base") + F.col("off")  # of the piece; its magic stands len(MAGIC) before
    placed = piece.join(base, ["file", "block"]).withColumn("at", start - len(MAGIC)).withColumn(
        "succ", F.when(F.col("head").isNotNull(), start + F.col("head") + 2 * len(END) + F.col("length")).otherwise(-1))
    placed = written(placed.filter("at >= 0"), "warc-candidates")
    jump = written(placed.filter("succ >= 0").select("file", "block", "at", "succ").groupBy("file", "block").applyInPandas(
        _leave, "file string, block long, at long, succ long, leaves long").select("file", "at", F.col("leaves").alias("to")), "warc-jumps")
    reach = written(jump.filter("at = 0").select("file", "at"), "warc-entries")
    n = reach.count()
    while True:
        step = reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(jump.select("file", "at"), ["file", "at"])
        reach = written(reach.unionByName(step).distinct(), "warc-entries")
        now = reach.count()
        if now == n:
            break
        n = now
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(far, ["file", "to"], "left").select("file", "at", F.coalesce("far", "to").alias("to")), "warc-jumps")
    # the chain enters each split once, at its smallest reached offset
    entry = placed.join(reach, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    chain = placed.select("file", "block", "at", "succ").join(entry, ["file", "block"], "left").withColumn(
        "entry", F.coalesce("entry", F.lit(-1))).groupBy("file", "block").applyInPandas(
        _on_chain, "file string, block long, at long, live boolean, owner long")
    marked = written(placed.join(chain, ["file", "block", "at"]), "warc-marked")
    parted = marked.filter("live and not full")
    if not parted.isEmpty():
        whole = _stitched(spark, path, marked, base)
        marked = marked.join(whole, ["file", "at"], "left").withColumn("sum", F.coalesce("sum", "whole_sum"))
    records = marked.filter("live")
    revisit = F.col("kind").startswith("revisit:")
    return records.select(
        "page_id", F.when(revisit, F.expr("try_cast(substr(kind, 9) as bigint)")).otherwise(F.col("length")).alias("payload_bytes"),
        F.col("sum").alias("payload_digest"), F.when(revisit, "revisit").otherwise(F.col("kind")).alias("record_type"), "refers_to")


def _stitched(spark, path: str, marked: DataFrame, base: DataFrame) -> DataFrame:
    """(file, at, whole_sum) of the records whose payload was cut by a magic inside it."""
    last = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = marked.groupBy("file", "block").agg(F.max("owner").alias("own")).select(
        "file", "block", F.max("own").over(last).alias("carried"))
    owned = marked.join(carry, ["file", "block"]).withColumn("owner", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("carried")))
    cut = marked.filter("live and not full").select("file", F.col("at").alias("owner"), F.col("head").alias("h"), F.col("length").alias("n"))
    need = written(owned.select("file", "block", "at", "owner").join(cut, ["file", "owner"]), "warc-cut")
    again = _scan(spark, path, True).join(base, ["file", "block"]).select(
        "file", "block", (F.col("base") + F.col("off") - len(MAGIC)).alias("at"), "value")
    parts = again.join(need, ["file", "block", "at"]).groupBy("file", "owner", "h", "n").agg(
        F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))  # the pieces of one record

    def joined(batches):
        for b in batches:
            sums = []
            for h, n, p in zip(b.column("h").to_pylist(), b.column("n").to_pylist(), b.column("parts").to_pylist()):
                body = MAGIC.join(x["value"] for x in p)
                got = body[h + len(END): h + len(END) + n]
                sums.append(digest(got) if len(got) == n else None)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("owner"), pa.array(sums, pa.string())], names=["file", "at", "whole_sum"])

    return parts.mapInArrow(joined, "file string, at long, whole_sum string")


def query(spark, sf_dir: str) -> DataFrame:
    from flowscore.llm.common import table
    path = scratch_path(spark, "warc-archives")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)
