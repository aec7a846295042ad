"""WARC archives: write, normalise from one gzip stream to a member per record, read back.

Writing. Every task writes its records as one monolithic gzip stream, as crawlers often
leave them: a ``response`` record with the page's bytes, or for a page whose bytes equal
those of one with a smaller id a ``revisit`` record that names it.

Normalising. A task inflates the stream of an archive once, from start to end and in
pieces, writes each record as a gzip member of its own, and beside the new archive a
sidecar index of (offset, length, record id, page id).

Reading. Records are fetched through the sidecar, each inflated alone.

Archives lie in the shared folder. Each attempt of a task writes files under names of its own
and moves nothing; the manifest, a table in that folder, names those of the attempt that was
finished, and only these are read. The monolithic archives are deleted once all are rewritten.

Defined results. A null page has an empty payload. Rows of equal payload and the same
smallest id are all responses. A null id is greater than any other: it names no response,
and such rows revisit the group's smallest id; if a group has only null ids, all are
responses. Line breaks in urls, and then percent signs too, are percent-encoded, which a header
of the record says; reading undoes it. An empty table gives no rows. Other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.text import opened
from quire.plans.staging import discard, new_path, removed, staged

PIECE = 1 << 18  # bytes inflated at a time
LEAST_REVISIT = 0  # bytes: smaller payloads are never written as revisits
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, a response or a revisit of refers_to."""
    uri = url or "about:blank"
    coded = "\r" in uri or "\n" in uri or uri != uri.strip()
    if coded:
        uri = "".join(f"%{ord(c):02X}" if c in "% \r\n\t\v\f" else c for c in uri)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    name = uuid.uuid5(NAMESPACE, f"{page_id} {uri} {kind}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http;msgtype=response",
    ]
    if coded:
        head.append("WARC-Target-URI-Encoded: yes")
    if refers_to is not None:
        head += [f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def records(pieces) -> "iter":
    """Whole records, cut from inflated pieces of a stream."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def inflate(stream):
    """Pieces of the data of a gzip file, of one member or several."""
    with gzip.GzipFile(fileobj=stream) as unzipped:
        while piece := unzipped.read(PIECE):
            yield piece


def member(data: bytes) -> bytes:
    zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipper.compress(data) + zipper.flush()


def normalise(stream, out) -> list[dict]:
    """Rewrite a monolithic archive, a member per record; the sidecar's rows."""
    offset, index = 0, []
    for r in records(inflate(stream)):
        packed = member(r)
        out.write(packed)
        h = headers(r[: r.find(b"\r\n\r\n")])
        index.append({"offset": offset, "length": len(packed), "record": h["warc-record-id"], "page": h["warc-page-id"]})
        offset += len(packed)
    return index


def parsed(raw: bytes) -> dict:
    """What a record tells: page_id, url, record_type, payload_bytes, payload_digest, refers_to and the payload (None in a revisit)."""
    end = raw.find(b"\r\n\r\n")
    h = headers(raw[:end])
    block = raw[end + 4 : end + 4 + int(h["content-length"])]
    cut = block.find(b"\r\n\r\n")
    payload = block[cut + 4 :] if h["warc-type"] == "response" else None
    stated = h["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and digest(payload) != stated:
        raise ValueError(f"digest of {h['warc-record-id']} does not hold")
    size = len(payload) if payload is not None else int(headers(block[:cut])["content-length"])
    number = lambda s: int(s) if s else None
    url = unquote(h["warc-target-uri"]) if "warc-target-uri-encoded" in h else h["warc-target-uri"]
    return {
        "page_id": number(h["warc-page-id"]), "url": url, "record_type": h["warc-type"], "payload_bytes": size,
        "payload_digest": stated, "refers_to": number(h.get("warc-refers-to-page-id", "")), "payload": payload,
    }


def attempt(folder: str) -> str:
    """A file name that no other attempt of any task has."""
    return f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"


def written(path: str, write) -> None:
    fs, local = opened(path)
    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(local, compression=None) as out:
        write(out)


def choose(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads the smallest id is kept whole."""
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"),
    )
    same = (F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    # Only groups with another row have revisits; their least ids are a small table of their own.
    least = staged(
        p.select("page_id", *same).groupBy("sha", "size").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & (F.col("size") >= LEAST_REVISIT)).drop("n"),
        "warc-least",
    )
    found = p.select("*", *same).join(least, ["sha", "size"], "left")
    return found.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to"))


def write_archives(chosen: DataFrame, folder: str) -> DataFrame:
    """Write the rows of choose() as monolithic archives, one for each partition; the manifest (archive, records)."""

    def run(batches):
        path, count = attempt(f"{folder}/raw"), 0

        def write(out):
            nonlocal count
            zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(zipper.compress(record(page_id, url, payload, refers_to)))
                    count += 1
            out.write(zipper.flush())

        written(path, write)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["archive", "records"])

    return staged(chosen.mapInArrow(run, "archive string, records long").filter("records > 0"), "warc-raw")


def spread(manifest: DataFrame, n: int) -> DataFrame:
    return manifest.repartition(max(1, n))


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive of a manifest as members with a sidecar; the new manifest (archive, sidecar, records).

    The old archives under folder and their manifest are gone after that.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column("archive").to_pylist():
                fs, local = opened(path)
                target = attempt(f"{folder}/normal")
                found: list[dict] = []

                def write(out, local=local, fs=fs, found=found):
                    with fs.open_input_stream(local, compression=None) as stream:
                        found += normalise(stream, out)

                written(target, write)
                lines = "".join(json.dumps(x) + "\n" for x in found).encode()
                written(f"{target}.idx", lambda out, lines=lines: out.write(lines))
                rows.append((target, f"{target}.idx", len(found)))
            names = ["archive", "sidecar", "records"]
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    n = manifest.count()
    normal = staged(spread(manifest.select("archive"), n).mapInArrow(run, "archive string, sidecar string, records long"), "warc-normal")
    removed(manifest.sparkSession, f"{folder}/raw")
    discard(manifest)
    return normal


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
    ]
)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for every record of normalised archives, fetched through their sidecars."""

    def run(batches):
        for batch in batches:
            for path, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                fs, local = opened(path)
                with fs.open_input_stream(opened(sidecar)[1], compression=None) as s:
                    index = [json.loads(x) for x in io.TextIOWrapper(io.BytesIO(s.read()))]
                rows: list[dict] = []
                with fs.open_input_file(local) as f:
                    for at in index:
                        f.seek(at["offset"])
                        row = parsed(zlib.decompress(f.read(at["length"]), 31))
                        rows.append(row if payloads else row | {"payload": None})
                        if len(rows) == 512:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    n = manifest.count()
    return spread(manifest.select("archive", "sidecar"), n).mapInArrow(run, READ)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], t) for f, t in zip(READ, kinds, strict=True)], names=READ.names)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    folder = new_path(spark, "warc")
    raw = write_archives(choose(table(spark, sf_dir, "pages")), folder)
    read = read_archives(normalise_archives(raw, folder), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
