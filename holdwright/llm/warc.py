"""WARC archives: write, normalise monolithic gzip streams, read by offset.

An archive that is one gzip stream can only be read from its start. The normaliser
inflates such a stream once, piece by piece, rewrites every record as a gzip member of its
own and writes an index of the members' offsets beside them, so that any record can be
read alone. Records with equal payloads are written once: one stays a response, the
others become revisits that name it and keep length and digest of the full payload.

Archives are rows (name, content, index) of a table in the shared folder; a row's
content is a valid .warc.gz file. A record's id is `<urn:x-page:N>`, N being the page's key.

Null html is the empty payload. A null url leaves out the target field. Rows with a
null page_id are responses that nothing refers to. Rows that share both page_id and
payload are alike: all with the largest page_id are responses. Rows that share a page_id with other
payloads are records of their own: each payload is judged by itself. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdwright.llm.tables import stored
from holdwright.operators.skew import skewed_lookup

ARCHIVE_BYTES = 8_000_000
READ_BYTES = 1 << 18
GZIP = 31
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("type", pa.string()), ("digest", pa.string())])
ENTRY_SQL = "array<struct<offset: bigint, length: bigint, page_id: bigint, type: string, digest: string>>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> bytes:
    return b"<urn:x-page:%s>" % (b"null" if page is None else str(page).encode())


def page_of(identifier: bytes) -> int | None:
    name = identifier.strip(b"<>").rsplit(b":", 1)[-1]
    return None if name == b"null" else int(name)


def http_block(size: int, payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload


def record_bytes(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"".join(b"%s: %s\r\n" % f for f in [*fields, (b"Content-Length", str(len(block)).encode())])
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def response(page: int | None, url: str | None, payload: bytes) -> tuple[bytes, str]:
    digest = payload_digest(payload)
    fields = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", record_id(page)), (b"WARC-Date", b"1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append((b"WARC-Target-URI", " ".join(url.split()).encode()))
    fields += [(b"WARC-Payload-Digest", b"sha1:" + digest.encode()), (b"Content-Type", b"application/http; msgtype=response")]
    return record_bytes(fields, http_block(len(payload), payload)), digest


def inflated(content: bytes) -> Iterator[bytes]:
    """Pieces of the text of a gzip file, one or many members."""
    view = memoryview(content)
    at = 0
    while at < len(view):
        stream = zlib.decompressobj(GZIP)
        while not stream.eof and at < len(view):
            piece = view[at : at + READ_BYTES]
            at += len(piece)
            yield stream.decompress(piece)
        at -= len(stream.unused_data)
        if not stream.eof:
            raise EOFError("archive ends inside a gzip member")


def records(pieces: Iterable[bytes]) -> Iterator[tuple[list[tuple[bytes, bytes]], bytes]]:
    """(fields, block) of every record of a WARC text that arrives in pieces."""
    buffer, source = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(source, None)
        if piece is not None:
            buffer.extend(piece)
        return piece is not None

    while True:
        while buffer.find(b"\r\n\r\n") < 0:
            if not more():
                if buffer.strip():
                    raise EOFError("archive ends inside a record's head")
                return
        end = buffer.find(b"\r\n\r\n")
        lines = bytes(buffer[:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = [tuple(line.split(b": ", 1)) for line in lines[1:]]
        size = int(dict(fields)[b"Content-Length"])
        while len(buffer) < end + 4 + size + 4:
            if not more():
                raise EOFError("archive ends inside a record's block")
        yield fields, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 8 + size]


def write_monolithic(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, content, manifest): archives that are one gzip stream each, with a list of their records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, parts, manifest, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), [], [], 0

        def close() -> pa.RecordBatch:
            content = b"".join([*parts, stream.flush()])
            name = hashlib.sha256(content).hexdigest()[:24] + ".warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([manifest], pa.list_(ENTRY))], names=["name", "content", "manifest"])

        for b in batches:
            for page, link, text in zip(*(c.to_pylist() for c in b.columns)):
                payload = (text or "").encode()
                record, digest = response(page, link, payload)
                parts.append(stream.compress(record))
                manifest.append({"offset": size, "length": len(payload), "page_id": page, "type": "response", "digest": digest})
                size += len(record)
                if size >= archive_bytes:
                    yield close()
                    stream, parts, manifest, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), [], [], 0
        if manifest:
            yield close()

    return pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), html).mapInArrow(run, f"name string, content binary, manifest {ENTRY_SQL}")


def revisits(archives: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(name, page_id, digest, refers_to) of every record whose payload a larger page has too."""
    listed = archives.select("name", F.explode("manifest").alias("m")).select("name", "m.page_id", "m.digest", "m.length").where(F.col("length") >= least_bytes)
    largest = listed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    return skewed_lookup(listed, largest, ["digest"], ["page_id"]).where("page_id < refers_to").select("name", "page_id", "digest", "refers_to")


def normalise(archives: DataFrame, known: DataFrame) -> DataFrame:
    """(name, content, index): every record a gzip member of its own, with its offset.

    `known` names the records that become revisits. Each archive meets its own short list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, refers = None, {}
        for b in batches:
            for at in range(b.num_rows):
                if (own := b.column(0)[at].as_py()) != name:
                    name, refers = own, {}
                content = b.column(2)[at].as_py()
                if content is None:
                    refers.update(zip(zip(b.column(3)[at].as_py(), b.column(4)[at].as_py()), b.column(5)[at].as_py()))
                    continue
                members, index, offset = [], [], 0
                for fields, block in records(inflated(content)):
                    member, entry = _member(fields, block, refers)
                    members.append(member)
                    index.append(entry | {"offset": offset, "length": len(member)})
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(members)], pa.binary()), pa.array([index], pa.list_(ENTRY))], names=["name", "content", "index"])

    nothing = F.lit(None).cast("array<bigint>")
    salted = known.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(64))).groupBy("name", "salt")
    lists = salted.agg(F.collect_list(F.struct("page_id", "digest", "refers_to")).alias("list"))
    marks = lists.select("name", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("content"), F.col("list.page_id").alias("pages"), F.col("list.digest").alias("digests"), F.col("list.refers_to").alias("targets"))
    bodies = archives.select("name", F.lit(1).alias("kind"), "content", nothing.alias("pages"), F.lit(None).cast("array<string>").alias("digests"), nothing.alias("targets"))
    rows = marks.unionByName(bodies).repartition("name").sortWithinPartitions("name", "kind")
    return rows.mapInArrow(run, f"name string, content binary, index {ENTRY_SQL}")


def _member(fields: list[tuple[bytes, bytes]], block: bytes, refers: dict[tuple[int | None, str], int]) -> tuple[bytes, dict]:
    named = dict(fields)
    page = page_of(named[b"WARC-Record-ID"])
    digest = named[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    kept = [f for f in fields if f[0] != b"Content-Length"]
    kind = "response"
    if (page, digest) in refers:
        kind = "revisit"
        kept = [(k, b"revisit" if k == b"WARC-Type" else v) for k, v in kept]
        kept += [(b"WARC-Refers-To", record_id(refers[page, digest])), (b"WARC-Profile", PROFILE)]
        block = block[: block.index(b"\r\n\r\n") + 4]
    packed = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packed.compress(record_bytes(kept, block)) + packed.flush(), {"page_id": page, "type": kind, "digest": digest}


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record, each member opened by its own offset; a response's digest is computed from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                content, index = b.column(0)[at].as_py(), b.column(1)[at].as_py()
                rows = [_record_row(content[e["offset"] : e["offset"] + e["length"]]) for e in index]
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("content", "index").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _record_row(member: bytes) -> tuple:
    (fields, block), *rest = records(inflated(member))
    if rest:
        raise ValueError("a member holds more than one record")
    named = dict(fields)
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rsplit(b"Content-Length: ", 1)[1])
    digest = named[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    kind = named[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload does not match its head")
    refers = page_of(named[b"WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(named[b"WARC-Record-ID"]), size, digest, kind, refers


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Normalised archives of a page table, written to the shared folder."""
    monolithic = stored(write_monolithic(pages))
    return stored(normalise(monolithic, revisits(monolithic, least_bytes)))
