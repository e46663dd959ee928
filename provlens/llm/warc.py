"""WARC archives compressed record by record with a shared Zstandard dictionary.

Every archive file (``.warc.zst``) starts with a skippable frame that holds the
dictionary, trained on records of that file, followed by one Zstandard frame
for each record, compressed with the dictionary. Any record can be read alone,
and a reader needs nothing but the file.

Records: a ``warcinfo`` record, then a ``response`` per page, or a ``revisit``
(profile *identical payload digest*) for a page whose payload equals that of a
page with a smaller id, if it has at least ``REVISIT_BYTES`` bytes. The payload
digest is SHA-256; a revisit keeps the HTTP header, whose ``Content-Length`` is
the length of the payload it leaves out.

On Spark: payloads are hashed where they are read; the smallest page id of each
digest is a grouping with partial minima, and pages meet it by digest (a hot
digest is split by AQE). Each task writes archives of about ``ARCHIVE_BYTES``,
under a temporary name that is renamed when the file is complete, and returns
a row per archive; a lost task writes again under another name and only the
names in the returned table count. Files go to the shared folder through
``pyarrow.fs``, so any file system it knows can be used. Reading deals the
archives out and streams each one, a record at a time.

Defined cases: a null html is an empty payload; a null url is an empty target;
a page without an id is written and read back without one, never referred to,
and revisits an equal page that has one; rows with the same smallest id are all
responses; too few or too small records for a dictionary leave the leading
frame out (a reader then needs none).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens.llm.common import filled, saved, shuffle_width
from provlens.session import scratch_dir

REVISIT_BYTES = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3
# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _header(fields: list[tuple[str, str]], size: int) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode()


def page_uri(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str = DATE) -> bytes:
    """One response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"
               if page_id is None else page_uri(page_id)),
              ("WARC-Date", date),
              # a line break in a url would end the header line
              ("WARC-Target-URI", quote(url or "", safe="".join(map(chr, range(33, 127))) + " ")),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        block = http + payload
    else:
        block = http
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", page_uri(refers_to))]
    return _header(fields, len(block)) + block + b"\r\n\r\n"


def info(date: str = DATE) -> bytes:
    block = b"format: WARC File Format 1.1\r\nsoftware: provlens\r\n"
    return _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                    ("Content-Type", "application/warc-fields")], len(block)) + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES):
    """A Zstandard dictionary from records spread evenly over ``records``, of
    ``sample`` bytes at most, or None where they are too few or too small."""
    total = sum(map(len, records))
    step = max(1, -(-total // sample))
    chosen = [r[:sample // 4] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, chosen)) // 8), chosen, level=LEVEL)
    except (zstandard.ZstdError, ValueError, MemoryError):
        return None


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The frames of one file."""
    trained = dictionary(records)
    if trained is not None:
        raw = trained.as_bytes()
        yield struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    else:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    yield pack.compress(info())
    for r in records:
        yield pack.compress(r)


def records_of(stream) -> Iterator[bytes]:
    """The records of a file, one at a time; only a window of the file and one
    record are held."""
    data, done, trained = bytearray(), False, None

    def fill(n: int) -> None:
        nonlocal done
        while len(data) < n and not done:
            more = stream.read(1 << 20)
            done = not more
            data.extend(more)

    fill(8)
    while len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic & 0xFFFFFFF0 != 0x184D2A50:
            break
        fill(8 + size)
        if magic == DICTIONARY_FRAME:
            trained = zstandard.ZstdCompressionDict(bytes(data[8:8 + size]))
        del data[:8 + size]
        fill(8)
    unpack = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    at = 0
    while True:
        frame, out = unpack.decompressobj(), []
        while not frame.eof:
            if at == len(data):
                data.clear()
                at = 0
                fill(1)
                if not data:
                    if out:
                        raise ValueError("an archive ends inside a frame")
                    return
            step = bytes(data[at:at + 8192])
            out.append(frame.decompress(step))
            at += len(step) - len(frame.unused_data)
        yield b"".join(out)


def parsed(raw: bytes) -> dict | None:
    """Page fields of a response or revisit record; digests are verified."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = body[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its digest")

    def page(value: str | None) -> int | None:
        return int(value[len("<urn:page:"):-1]) if value and value.startswith("<urn:page:") else None

    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")),
            "payload": payload if fields["WARC-Type"] == "response" else None}


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): what to write."""
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                       F.encode(filled(html), "UTF-8").alias("payload"))
    src = src.withColumn("digest", F.sha2("payload", 256))
    least = (src.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy(F.col("digest").alias("same"))
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    joined = src.join(least, src["digest"] == least["same"], "left")
    repeats = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(repeats, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives below ``folder``; the table of archives (path,
    records, bytes), itself saved."""
    def each(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def flush(records):
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            size = 0
            with store.open_output_stream(name + ".part") as out:
                for frame in archive(records):
                    out.write(frame)
                    size += len(frame)
            store.move(name + ".part", name)
            return pd.DataFrame({"path": [name], "records": [len(records)], "bytes": [size]})

        held, size = [], 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                def number(x):
                    return None if pd.isna(x) else int(x)
                r = record(number(row.page_id), row.url, bytes(row.payload), row.digest, number(row.refers_to))
                if held and size + len(r) > archive_bytes:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield flush(held)

    ids = [F.col(c).cast("decimal(20,0)").alias(c) for c in ("page_id", "refers_to")]  # null stays apart from a number
    rows = planned(pages).select("url", "payload", "digest", *ids)
    return saved(rows.mapInPandas(each, "path string, records bigint, bytes bigint"), "archives")


def read(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every page record of the archives."""
    def each(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path in pdf["path"]:
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in records_of(stream):
                        row = parsed(raw)
                        if row is None:
                            continue
                        if not payloads:
                            row.pop("payload")
                        rows.append(row)
                        size += len(raw) if payloads else 0
                        if len(rows) >= 10_000 or size > 16 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows):
        pdf = pd.DataFrame(rows)
        for c in ("page_id", "refers_to"):
            pdf[c] = pdf[c].astype("Int64")
        return pdf

    schema = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
              + ", payload binary" * payloads)
    n = shuffle_width(archives.sparkSession)
    return archives.select("path").repartition(n).mapInPandas(each, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder and read the archives back."""
    folder = scratch_dir(pages.sparkSession, "llm-warc")
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[len("file:"):]
    return read(write(pages, folder), folder)
