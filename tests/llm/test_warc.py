from __future__ import annotations

import glob
import hashlib
import io
import struct

import zstandard

from provlens.llm import warc
from provlens.session import scratch_dir

SCHEMA = "page_id bigint, url string, html string, digest string, first bigint, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def rows():
    body = "<p>" + "a payload of some length " * 10
    out = [(i, f"http://x/{i}", f"<html>{i} {body}{i * 17 % 97}</html>") for i in range(60)]
    out += [(100 + i, "http://copy/", body) for i in range(20)]
    out += [(200, "u", "short"), (201, "u", "short"), (202, None, None), (203, "é\r\nX-Bad: 1", "é" * 60),
            (204, "u", "é" * 60), (None, "no id", body), (None, None, "alone " * 40), (90, "u", body), (90, "u", body),
            (300, "long", "<b>ünï</b>\r\n\r\n" * 60_000)]
    return out


def brute(data):
    least = {}
    for i, _, h in data:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            least[b] = min(i, least.get(b, i))
    out = []
    for i, _, h in data:
        b = (h or "").encode()
        first = least.get(b)
        again = first is not None and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def test_archives_read_back(spark):
    got = [tuple(r) for r in warc.archived(pages(spark, rows()).repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows()), key=str)


def test_payloads_and_layout_of_the_files(spark):
    folder = scratch_dir(spark, "warc-test")
    folder = "file://" + folder[5:] if folder.startswith("file:/") and "://" not in folder else folder
    archives = warc.write(pages(spark, rows()).coalesce(1), folder)
    back = {r["page_id"]: r for r in warc.read(archives, folder, payloads=True).collect()}
    for i, _, h in rows():
        if i is not None and back[i]["record_type"] == "response":
            assert bytes(back[i]["payload"]) == (h or "").encode()
    files = glob.glob(folder.removeprefix("file://") + "/*")
    assert sorted(files) == sorted(r["path"] for r in archives.collect())
    framed = 0
    for path in files:
        data = open(path, "rb").read()
        magic, size = struct.unpack_from("<II", data)
        if magic != warc.DICTIONARY_FRAME:
            continue
        framed += 1
        trained = zstandard.ZstdCompressionDict(data[8:8 + size])
        assert trained.dict_id()
        first = zstandard.ZstdDecompressor(dict_data=trained).decompressobj().decompress(data[8 + size:])
        assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert framed


def test_small_archives_need_no_dictionary():
    records = [warc.record(1, "u", b"x", hashlib.sha256(b"x").hexdigest(), None)]
    data = b"".join(warc.archive(records))
    assert struct.unpack_from("<I", data)[0] != warc.DICTIONARY_FRAME
    assert [warc.parsed(r) for r in warc.records_of(io.BytesIO(data))][1]["page_id"] == 1


def test_a_cut_archive_is_an_error():
    data = b"".join(warc.archive([warc.record(i, "u", b"y" * 500, hashlib.sha256(b"y" * 500).hexdigest(), None)
                                  for i in range(30)]))
    try:
        list(warc.records_of(io.BytesIO(data[:-3])))
    except (ValueError, zstandard.ZstdError):
        return
    raise AssertionError("a cut archive was read to its end")


def test_empty_table(spark):
    assert warc.archived(pages(spark, [])).collect() == []
