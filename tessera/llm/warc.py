"""WARC archives: writing one gzip member per record, and reading them sequentially with bounded memory.

Archives lie in a folder that all executors share, opened through ``pyarrow.fs`` by their address (``file:``,
``hdfs:``, ``s3:`` ...). A task writes its archive under a name of its own and puts it in place when it is complete,
so a task that runs again replaces its own archive only.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import IO, Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import named, new_path, stored

#: Bytes read from an archive, and inflated from a member, at a time.
_READ = 1 << 18
#: Bytes in which a record's header must end.
_MOST_HEAD = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes | memoryview) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None) -> str:
    """The name of a page's record; rows that repeat an id share it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


_UNSAFE = re.compile(r"[\x00-\x20\x7F]")


def url_fields(url: str) -> dict[str, str]:
    """The address as a header can hold it; one with spaces or control signs is percent-encoded and also kept as it is."""
    safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    return {"WARC-Target-URI": safe} | ({"X-Original-URL": json.dumps(url)} if safe != url else {})


def record_bytes(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own. Line ends in field values become spaces."""
    head = {"WARC-Type": kind} | {k: " ".join(v.splitlines()) for k, v in fields.items()} | {"Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + packer.flush()


class WarcError(ValueError):
    """An archive or record that breaks the format, its length or its digest."""


def _members(stream: IO[bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated chunks of each gzip member in turn; a member must be used up before the next is asked for."""
    rest = b""
    while True:
        rest = rest or stream.read(_READ)
        if not rest:
            return
        state: dict[str, Any] = {"rest": rest, "done": False}

        def chunks(state: dict[str, Any] = state) -> Iterator[bytes]:
            unpacker = zlib.decompressobj(31)
            data = state["rest"]
            while not unpacker.eof:
                data = data or stream.read(_READ)
                if not data:
                    raise WarcError("the archive ends inside a gzip member")
                out = unpacker.decompress(data, _READ)
                data = unpacker.unconsumed_tail
                if out:
                    yield out
            state["rest"], state["done"] = unpacker.unused_data, True

        yield chunks()
        if not state["done"]:
            raise WarcError("a gzip member was left unread")
        rest = state["rest"]


def _parsed(head: bytes) -> tuple[dict[str, str], int]:
    """Fields by lower-case name, and the block's length."""
    first, *lines = head.decode("utf-8").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not first.startswith("WARC/1.") or not fields.get("content-length", "").isdecimal():
        raise WarcError("a record lacks its header")
    return fields, int(fields["content-length"])


def read_records(stream: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(fields, block)`` of each record; field names are in lower case.

    The header is read first; its Content-Length frames what follows while it is inflated, so a record that goes on past
    its frame is refused at once. A response's payload digest is verified; a revisit has no payload of its own. The
    block of one record is held at a time.
    """
    for member in _members(stream):
        head, block, after = bytearray(), bytearray(), bytearray()
        fields: dict[str, str] | None = None
        size = 0
        for chunk in member:
            if fields is None:
                head += chunk
                cut = head.find(b"\r\n\r\n", max(0, len(head) - len(chunk) - 3))
                if cut < 0:
                    if len(head) > _MOST_HEAD:
                        raise WarcError("a record's header doesn't end")
                    continue
                fields, size = _parsed(bytes(head[:cut]))
                chunk = bytes(head[cut + 4 :])
            room = size - len(block)
            block += chunk[:room]
            after += chunk[room:]
            if len(after) > 4:
                break
        if fields is None:
            raise WarcError("a record lacks its header")
        if len(block) != size or after != b"\r\n\r\n":
            raise WarcError(f"a record's length differs from its Content-Length {size}")
        if fields.get("warc-type") == "response" and fields.get("warc-payload-digest") != f"sha1:{payload_digest(memoryview(block)[_payload_at(block) :])}":
            raise WarcError("a payload differs from its digest")
        yield fields, bytes(block)


def _payload_at(block: bytes | bytearray) -> int:
    end = block.find(b"\r\n\r\n")
    return len(block) if end < 0 else end + 4


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    return block[_payload_at(block) :]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write every row as a record into archives under ``folder``; returns ``(path, n_records)``, computed at once.

    Among payloads of ``least_bytes`` or more that are equal, the row with the smallest id (nulls last)
    is a response, and so are rows that repeat its id; the others revisit it; smaller payloads are all responses. A null html is an
    empty payload, a null url is empty, a null id is kept as none; other columns are left out. Equal payloads meet by digest in a
    small aggregate, and rows join it; Spark splits a digest that has too many rows.
    """
    rows = pages.select(named(id_col).cast("long").alias("page_id"), F.coalesce(named(url), F.lit("")).alias("url"), F.coalesce(named(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least_bytes
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    # stored, so that Spark knows its size, broadcasts it only if that is small, and else can split a frequent digest
    shared = stored(first.where("n > 1").select("digest", "first_id"), "digests")
    framed = rows.join(shared, "digest", "left").withColumn("first_id", F.when(large, F.col("first_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{uuid.uuid4().hex}"
        count = 0
        with store.open_output_stream(f"{name}.open", compression=None) as out:
            for batch in batches:
                for k in range(len(batch)):  # one payload at a time
                    r = {c: batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "first_id")}
                    again = r["first_id"] is not None and r["first_id"] != r["page_id"]
                    payload, head = r["payload"], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    fields = {
                        "WARC-Record-ID": record_urn(r["page_id"]), "WARC-Date": _DATE, **url_fields(r["url"]), "Content-Type": "application/http;msgtype=response",
                        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "X-Page-ID": "" if r["page_id"] is None else str(r["page_id"]), "X-Payload-Length": str(len(payload)),
                    }
                    if again:
                        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_urn(r["first_id"]), "X-Refers-To-Page-ID": str(r["first_id"])}
                    out.write(record_bytes("revisit" if again else "response", fields, head if again else head + payload))
                    count += 1
        store.move(f"{name}.open", f"{name}.warc.gz")
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{name.rpartition('/')[2]}.warc.gz"]), "n_records": pa.array([count], pa.int64())})

    return stored(framed.mapInArrow(run, "path string, n_records long"), "archives")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives that ``write_archives`` returned, each archive read from front to back in a task.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` (and ``payload``, null for revisits).
    Archives of attempts that were not kept are not in the list and so are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        number = lambda text: int(text) if text else None

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if with_payload else [])]))

        for listed in batches:
            for path in listed.column(0).to_pylist():
                rows: list[dict] = []
                with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for f, block in read_records(stream):
                        full = f["warc-type"] == "response"
                        payload = payload_of(block)
                        row = {
                            "page_id": number(f["x-page-id"]), "url": json.loads(f["x-original-url"]) if "x-original-url" in f else f["warc-target-uri"], "payload_bytes": len(payload) if full else int(f["x-payload-length"]), "payload_digest": f["warc-payload-digest"].removeprefix("sha1:"),
                            "record_type": f["warc-type"], "refers_to": number(f.get("x-refers-to-page-id")),
                        }
                        rows.append(row | ({"payload": payload if full else None} if with_payload else {}))
                        if len(rows) == (64 if with_payload else 4_096):
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    tasks = max(1, archives.count())
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back; a row comes back for every row.

    A null html is an empty payload and a null url empty; null and repeated ids stay, and so do repeated rows; urls come
    back as they were, whatever signs they hold. Payloads of any length are written and read whole, one at a time. Of
    equal payloads the smallest id is the response. Other columns are left out; an empty table gives an empty result.
    """
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder, with_payload)
