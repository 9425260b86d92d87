"""WARC archives: written by tasks, indexed first, read back by coalesced sorted byte ranges.

Writing yields an index row per record: file, offset, length, URL, digest. Archives of lost or repeated task
attempts are named by no index row, because only a finished task's rows are in the index table. Reading takes
any selection of index rows, sorts them by place, joins neighbours into ranges, and reads each range at once.
Files are opened through the file system that the folder's URI names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, shared_folder, table

#: Payloads from so many bytes are stored once.
LEAST_SHARED = 1000
#: Bytes of an archive from which a new one is begun; of a range; of unread bytes that a range may bridge; and that one reading task takes, or so.
ARCHIVE, RANGE, GAP, SHARE = 256 << 20, 4 << 20, 64 << 10, 256 << 20
#: No date is known for a page; equal inputs give equal archives.
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long"


def _record(page: int | None, url: str | None, html: bytes, digest: str, refers: int | None, refers_url: str | None, revisit: bool, place: str) -> bytes:
    """One gzip member. Headers of ours: X-Page-Id, X-Payload-Bytes (a revisit has no payload to count), X-Page-Url.

    A URL stands as it is, with characters that no header can hold escaped; if there are any, X-Page-Url holds the
    URL with all its signs escaped, so that reading gives it back to the letter.
    """
    block = b"" if revisit else _HTTP + html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"]
    link = lambda u: quote(u, safe=":/?#[]@!$&()*+,;=%-._~'", errors="surrogatepass")
    head += [f"WARC-Target-URI: {link(url)}"] if url is not None else []
    head += [f"X-Page-Url: {quote(url, safe='', errors='surrogatepass')}"] if url is not None and link(url) != url else []
    head += [f"X-Page-Id: {page}"] if page is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(html)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] + ([f"X-Refers-To-Page: {refers}"] if refers is not None else [])
        head += [f"WARC-Refers-To-Target-URI: {link(refers_url)}", f"WARC-Refers-To-Date: {DATE}"] if refers_url is not None else []
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _parsed(data: bytes) -> dict:
    data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    number = lambda k: int(fields[k]) if k in fields else None
    url = unquote(fields["X-Page-Url"], errors="surrogatepass") if "X-Page-Url" in fields else fields.get("WARC-Target-URI")
    return {"page_id": number("X-Page-Id"), "url": url, "record_type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"][5:], "payload_bytes": number("X-Payload-Bytes"), "refers_to": number("X-Refers-To-Page"), "payload": payload}


def _write(pages: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    out, name, at = None, "", 0
    for batch in pages:
        rows = {c: [] for c in ("file", "offset", "length", "page_id", "url", "digest", "payload_bytes", "record_type", "refers_to")}
        for x in batch.to_pylist():
            if out is None or at > ARCHIVE:
                if out is not None:
                    out.close()
                name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                info = b"software: ledgerloom\r\nformat: WARC File Format 1.1\r\n"
                first = pack.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n") + pack.flush()
                out.write(first)
                at = len(first)
            html = x["html"] or b""
            data = _record(x["page_id"], x["url"], html, x["digest"], x["leader"], x["leader_url"], x["revisit"], f"{name} {at}")
            out.write(data)
            for c, v in (("file", name), ("offset", at), ("length", len(data)), ("page_id", x["page_id"]), ("url", x["url"]), ("digest", x["digest"]), ("payload_bytes", len(html)), ("record_type", "revisit" if x["revisit"] else "response"), ("refers_to", x["leader"] if x["revisit"] else None)):
                rows[c].append(v)
            at += len(data)
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))
    if out is not None:
        out.close()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` in ``folder``; the index, as a written table.

    Of records with equal payloads of LEAST_SHARED bytes or more, that with the largest page_id is a response
    and the others revisit it (repeated rows with that id are all responses; rows without an id revisit it, or
    are all responses if no row has one). Payloads are compared by SHA-1 and length. Null html is an empty payload.
    """
    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("binary"), F.lit(b"")).alias("html"))
    slim = slim.withColumn("digest", F.sha1("html"))
    size = F.octet_length("html")
    copies = slim.filter(size >= LEAST_SHARED).groupBy("digest", size.alias("size")).agg(F.max("page_id").alias("leader"), F.max_by("url", "page_id").alias("leader_url"), F.count("*").alias("c")).filter("c > 1")
    copies = kept(copies.select(F.col("digest").alias("__digest"), F.col("size").alias("__size"), "leader", "leader_url"))
    full = slim.join(copies, (F.col("digest") == F.col("__digest")) & (size == F.col("__size")), "left")
    full = full.withColumn("revisit", F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")))
    return kept(full.select("page_id", "url", "html", "digest", "leader", "leader_url", "revisit").mapInArrow(partial(_write, folder=folder), INDEX))


def _read(ranges: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(folder)
    for batch in ranges:
        for x in batch.to_pylist():
            with store.open_input_file(f"{base}/{x['file']}") as f:
                data = f.read_at(x["till"] - x["start"], x["start"])
            found = []
            for r in x["records"]:
                one = _parsed(data[r["offset"] - x["start"] :][: r["length"]])
                if one["payload"] is not None and (len(one["payload"]) != one["payload_bytes"] or hashlib.sha1(one["payload"]).hexdigest() != one["digest"]):
                    raise ValueError(f"{x['file']} at {r['offset']}: the payload is not what its header says")
                if not payloads:
                    one["payload"] = None
                found.append(one)
            types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([o["digest" if c == "payload_digest" else c] for o in found], t) for c, t in types.items()], list(types))


def _records(index: DataFrame, folder: str, payloads: bool) -> DataFrame:
    """Ranges are dealt to tasks by the bytes of the archives that they name, not by those of the index's rows: a range each while there are
    fewer than shuffle partitions, and about SHARE bytes a task beyond."""
    spark = index.sparkSession
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = min(total // RANGE + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARE + 1))
    place = W.partitionBy("file", "part").orderBy("offset")
    rows = index.select("file", "offset", "length", (F.col("offset") / RANGE).cast("long").alias("part")).repartition(int(tasks), "file", "part")
    rows = rows.withColumn("breaks", F.coalesce(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(place) > GAP, F.lit(False)).cast("int"))
    rows = rows.withColumn("run", F.sum("breaks").over(place))
    ranges = rows.groupBy("file", "part", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("till"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
    return ranges.mapInArrow(partial(_read, folder=folder, payloads=payloads), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read(index: DataFrame, folder: str, payloads: bool = True, whole: DataFrame | None = None) -> DataFrame:
    """The records that ``index`` (any selection of its rows) names, with payloads if wanted.

    Records of a file that start in the same RANGE bytes and leave no more than GAP bytes between them are one
    read. Every payload is held against its digest. A revisit holds none of its own: with the ``whole`` index, the response that it revisits is
    read too, once for all its copies, and gives the payload; without, it stays null.
    """
    rows = _records(index, folder, payloads)
    if not payloads or whole is None:
        return rows
    same = ["digest", "payload_bytes"]
    asked = index.filter("record_type = 'revisit'").select(*same).distinct()
    first = whole.filter("record_type = 'response'").join(asked, same).groupBy(*same).agg(F.min(F.struct("file", "offset", "length")).alias("at"))
    shared = _records(first.select("at.*"), folder, True).select(F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"), F.col("payload").alias("__payload"))
    rows = rows.join(shared, (F.col("record_type") == "revisit") & (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes")), "left")
    return rows.withColumn("payload", F.coalesce("payload", "__payload")).drop("__digest", "__bytes", "__payload")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record, as read back."""
    folder = shared_folder(spark)
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS m FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND m > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND m > page_id THEN m END AS refers_to FROM d
"""
