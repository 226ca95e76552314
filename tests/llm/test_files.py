import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from civitext.llm import token_files
from civitext.llm.queries import tokenizer_path
from civitext.llm.token_files import Encoder, read_token_files, write_token_files
from civitext.llm.warc import CHUNK, archived_pages, page_records, payload_chunks, read_warc, write_warc

TOKENIZERS = pytest.importorskip("tokenizers")


def texts():
    rng = random.Random(4)
    spaces = [" ", "  ", "\n", "\n\n", "\t", " \n", " ", "  ", "\r\n", "   ", "\x1c", "​"]
    parts = ["it's", "The", "é", "12", "!!", "x.y", "<|endoftext|>", "漢字", "\U0001f600", "a-b", "'ll", ".\nThen"]
    out = ["", " ", "\n", None, "a", " a", "a ", "<|endoftext|>", "word " * 30_000]
    return out + ["".join(rng.choice(parts) + rng.choice(spaces) for _ in range(rng.randrange(1, 40))) for _ in range(300)]


def hashed(text):
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).astype(np.int64))


@pytest.mark.parametrize("parts", [1, 5])
def test_tokens_come_back_as_encoded(spark, tmp_path, parts):
    rows = [(i * 3 - 50, t, "x") for i, t in enumerate(texts())] + [(None, "no key", "x"), (7, "tie b", "x"), (7, "tie a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    path = tokenizer_path("byte_bpe_50k.json")
    whole = TOKENIZERS.Tokenizer.from_file(path)
    listed = write_token_files(docs, str(tmp_path), path, parts=parts)
    got = sorted(read_token_files(listed, str(tmp_path)).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]), r[1] or ""))
    assert [r["key"] for r in got] == [r[0] for r in order]
    start = 0
    for r, (_, text, _) in zip(got, order):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["start"] == start
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_encoder_starts_anew_and_takes_every_space(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 1000)
    path = tokenizer_path("byte_bpe_50k.json")
    whole, encoder = TOKENIZERS.Tokenizer.from_file(path), Encoder(path, "<u2")
    assert encoder.by_piece
    spaces = [chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice(("a", "b1", "'s", "?", "é", "'llé", "½", "Ωж", "ا", "_")) + rng.choice(spaces) * rng.randrange(3) for _ in range(60))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    every = [chr(c) for c in range(0x2FF0) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 40):  # each character after a blank, a letter, a number and another sign
        text = "".join(f" {c} a{c}1{c}?{c}b" for c in every[at : at + 40])
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_off_local_disk_are_read_in_parts(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(4500)], "doc_id long, text string").coalesce(1)
    listed = write_token_files(docs, str(tmp_path), tokenizer_path("byte_bpe_50k.json"), parts=1)
    row = listed.collect()[0].asDict()
    batch = token_files.pa.RecordBatch.from_pylist([row])
    local = [r for b in token_files._reader(str(tmp_path), True)(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(token_files.fs, "LocalFileSystem", int)
    store, path = token_files.fs.FileSystem.from_uri(f"file://{tmp_path}")
    monkeypatch.setattr(token_files, "store_of", lambda uri: (store, path))
    assert [r for b in token_files._reader(str(tmp_path), True)(iter([batch])) for r in b.to_pylist()] == local
    assert len(local) == 4500


def test_no_documents_make_no_files(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    listed = write_token_files(docs, str(tmp_path), tokenizer_path("byte_bpe_50k.json"))
    assert listed.count() == 0 and read_token_files(listed, str(tmp_path)).count() == 0


PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/ x\r\ny", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "é", ""), (4, "u", None),
    (5, "u", "é " * 50_000), (6, "u", "x" * CHUNK), (8, "u", "x" * CHUNK), (None, "u", "alone"), (None, "u", "<p>one</p>"),
    (11, "u", "twice"), (11, "u", "twice"), (12, "u", "WARC/1.1\r\n\r\n"),
]


def test_pages_come_back_from_archives(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, size string").repartition(3)
    got = page_records(archived_pages(pages)).collect()
    head = {}
    for key, _, html in PAGES:
        if key is not None:
            head[html or ""] = max(key, head.get(html or "", key))
    want = []
    for key, _, html in PAGES:
        raw = (html or "").encode()
        first = head.get(html or "")
        refers = None if key == first else first
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((key, len(raw), digest, "response" if refers is None else "revisit", refers))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_chunks_hold_the_payload(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    listed = write_warc(payload_chunks(pages, chunk=1000), str(tmp_path))
    rows = read_warc(listed, str(tmp_path), chunk=700).filter("record_id = '<urn:page:5>'").collect()
    rows.sort(key=lambda r: r["chunk_no"])
    raw = PAGES[5][2].encode()
    assert b"".join(bytes(r["data"]) for r in rows) == raw and max(len(r["data"]) for r in rows) == 700
    running = hashlib.sha1()
    for r in rows:
        running.update(r["data"])
        assert r["digest"] == base64.b32encode(running.digest()).decode()
    assert [r["last"] for r in rows] == [False] * (len(rows) - 1) + [True]


def test_no_pages(spark):
    assert page_records(archived_pages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
