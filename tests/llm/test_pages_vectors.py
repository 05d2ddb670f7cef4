"""Archives and neighbours against plain Python, and the pipeline on small tables."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from fixtures import CLASHING, SF, odd_docs
from pyspark.sql import functions as F

from sparkrounds.llm import ann, warc
from test_documents import check_packing

PAGES = [
    (3, "http://a/x y\n", "<p>one</p>" * 30),
    (1, None, "<p>one</p>" * 30),
    (1, None, "<p>one</p>" * 30),
    (2, "http://b", None),
    (None, "http://c", ""),
    (7, "http://d", "é" * 50_000),
    (8, "http://e", "a\r\n\r\nb WARC/1.1\r\n\r\n"),
    *[(20 + i, f"http://s/{i}", f"<html><head><title>page {i}</title></head><body>{'text ' * i}</body></html>") for i in range(40)],
]


def _pages(spark, rows=PAGES):
    return spark.createDataFrame(
        [(*r, *CLASHING) for r in rows], "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in CLASHING)
    )


def test_archives_round_trip(spark):
    for least in (0, 301):
        folder = warc.archive_folder(spark)
        manifest = warc.write_archives(_pages(spark).repartition(3), folder, min_payload=least, archive_bytes=3000)
        out = warc.read_archives(manifest, folder, with_payload=True).collect()
        assert len(out) == len(PAGES) and manifest.agg(F.sum("records")).first()[0] == len(PAGES)
        data = {}
        for page, _, html in PAGES:
            data.setdefault(page, (html or "").encode())
        for r in out:
            payload = data[r.page_id]
            sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert (r.payload_bytes, r.payload_digest) == (len(payload), sha)
            assert bytes(r.payload) == (payload if r.record_type == "response" else b"")
        kinds = sorted((r.page_id, r.record_type, r.refers_to) for r in out if r.page_id in (1, 3))
        if least == 0:
            assert sorted(k for k in kinds if k[1] == "response") == [(1, "response", None)]
            assert sorted(k for k in kinds if k[1] == "revisit") == [(1, "revisit", 1), (3, "revisit", 1)]
            empty = {r.page_id: (r.record_type, r.refers_to) for r in out if not r.payload_bytes}
            assert empty == {2: ("response", None), None: ("revisit", 2)}
        else:
            assert {k[1] for k in kinds} == {"response"}


def test_archive_has_its_dictionary(spark, tmp_path):
    import zstandard

    folder = f"file://{tmp_path}/archives"
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    manifest = warc.write_archives(pages, folder)
    for r in manifest.collect():
        data = open(f"{tmp_path}/archives/{r.archive}", "rb").read()
        assert len(data) == r.bytes and int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
        size = int.from_bytes(data[4:8], "little")
        book = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        first = zstandard.ZstdDecompressor(dict_data=book).decompressobj().decompress(data[8 + size :])
        assert first.startswith(b"WARC/1.1\r\n")
    # Files that no manifest names are not read.
    (tmp_path / "archives" / "lost.warc.zst").write_bytes(b"junk")
    assert warc.read_archives(manifest, folder).count() == 250


@pytest.mark.parametrize("n, size", [(60, 25_000), (2, 40), (1, 0)])
def test_dictionary_of_long_few_and_empty_pages(spark, tmp_path, n, size):
    rows = [(i, "http://x", f"{i} <p>long</p> {'word ' * size}"[:size]) for i in range(n)]
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(_pages(spark, rows), folder)
    for r in manifest.collect():
        data = open(f"{tmp_path}/archives/{r.archive}", "rb").read()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME and int.from_bytes(data[4:8], "little") > 100
    out = warc.read_archives(manifest, folder, with_payload=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in out} == {i: html for i, _, html in rows}


def test_hot_payloads_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    rows = [(i, None, "hot" if i % 3 else f"page {i // 6}") for i in range(300)]
    folder = warc.archive_folder(spark)
    out = warc.read_archives(warc.write_archives(_pages(spark, rows), folder), folder).collect()
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    want = {i: first[html] if first[html] != i else None for i, _, html in rows}
    assert {r.page_id: r.refers_to for r in out} == want and len(out) == 300


def test_damaged_archives_are_refused(spark, tmp_path):
    import zstandard

    folder = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(_pages(spark).coalesce(1), folder)
    path = f"{tmp_path}/archives/{manifest.first().archive}"
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-3])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(manifest, folder).collect()
    # A payload of the same length that is not what the digest says, in a frame that is whole.
    good = warc.record(5, "http://x", b"one", hashlib.sha1(b"one").hexdigest(), None, False)
    for record, error in ((good, None), (good.replace(b"one", b"two"), "payload of")):
        open(path, "wb").write(zstandard.ZstdCompressor().compress(record))
        if error is None:
            assert [tuple(r)[:2] for r in warc.read_archives(manifest, folder).collect()] == [(5, 3)]
        else:
            with pytest.raises(Exception, match=error):
                warc.read_archives(manifest, folder).collect()


def test_no_pages(spark):
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(_pages(spark).limit(0), folder)
    assert warc.read_archives(manifest, folder).count() == 0


def _brute(rows, every, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q, v in rows:
        if q % every == 0:
            d = np.sqrt(((x - np.asarray(v, dtype=np.float64)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_neighbours_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = _brute(rows, 20)
    out = ann.search(vectors, queries="id % 20 = 0", sample_rows=1024, rows_per_part=100).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert all(len(v) == 10 for v in got.values()) and got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_in_blocks_of_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8).astype(np.float32)
    rows = [(i, base.tolist() if i % 3 else rng.standard_normal(8).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search(df, queries="id % 10 = 0").collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == _brute(rows, 10)


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [1.0, None]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [0.0, 2.0])]
    df = spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, id string, part string"
    )
    out = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, queries="id = 9").collect())
    assert out == [(9, 1, 0), (9, 2, 0), (9, 3, 1)]
    assert ann.search(df.limit(0)).count() == 0


def test_balanced_parts_follow_the_graph():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((64, 4)) + 12 * np.eye(4)[i] for i in range(4)])
    label = ann.balanced_parts(ann.neighbour_graph(x, 5), 4)
    assert sorted(np.bincount(label)) == [64] * 4
    assert all(np.bincount(label[64 * i : 64 * i + 64]).max() >= 60 for i in range(4))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = odd_docs(spark)
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.count()
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("clashing", [False, True])
def test_pipeline_keeps_one_row_of_each_component(spark, clashing):
    import corpus_pipeline as p

    make = lambda tag, k=60: " ".join(f"{tag}{i}" for i in range(k))
    near = lambda tag: make(tag) + " and more"
    rows = [
        (1, make("a")), (None, near("a")), (None, make("b")), (None, make("c")), (None, near("c")),
        (2, make("d")), (7, near("d")), (7, make("e")),
        (8, make("f")), (8, near("f")), (9, make("g")), (9, make("g")), (None, make("h")), (None, make("h")),
        (10, None), (11, ""), (None, ""),
    ]
    docs = odd_docs(spark, [(*r, "a") for r in rows]).repartition(3)
    docs = docs if clashing else docs.select("doc_id", "text", "source")
    out = p.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert len(left) == len(set(left))
    # Of two near copies with the same key either may stay.
    either = [x for x in left if x in ((None, make("c")), (None, near("c"))) or x[0] == 8]
    assert sorted((x is None, x or 0) for x, _ in either) == [(False, 8), (True, 0)]
    want = {(1, make("a")), (None, make("b")), (2, make("d")), (7, make("e")), (9, make("g")), (None, make("h"))}
    assert set(left) - set(either) == want | {(10, None), (11, ""), (None, "")}


def test_pipeline_runs(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, SF), "test-stage")
    ids = [(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()]
    once = docs.dropDuplicates(["doc_id"])
    check_packing(p.STAGES[-1][1](spark, once, SF).collect(), ids)
    assert p.run(spark, SF).columns == [c.split()[0] for c in p.packing.PIECES.split(", ")]
