"""WARC archives compressed record by record with a shared Zstandard dictionary.

The dictionary is trained on the beginnings of a bounded sample of the distinct
records to be archived, long or short, and stands in a skippable frame at the head
of every archive, so each archive can be read on its own; every record is a frame
of its own, with a checksum.  Payloads seen before are archived as revisits of the
record with the smallest identifier.  Reading measures and hashes every payload.

Archives are written by the tasks to a folder that all executors share (local,
HDFS or object store, through ``pyarrow.fs``).  An archive counts only when its
name is in the manifest, which Spark commits; files of lost attempts are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrounds.functions.sizing import lookup
from sparkrounds.plans.lineage import materialize, materialize_counted, scratch_path

# The WARC and Zstandard formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_RECORDS = 1_000
EXCERPT_BYTES = 8 << 10
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 64 << 20
# Tables of at most so many repeated payloads are broadcast.
BROADCAST_PAYLOADS = 200_000
DATE = "2026-01-01T00:00:00Z"

HEADER = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def base32_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def clean_uri(url: str | None) -> str:
    """One line without spaces, as header values must be."""
    from urllib.parse import quote

    return quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; ``revisit`` ones carry the HTTP headers only."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
        f"WARC-Target-URI: {clean_uri(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_digest(sha1_hex)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if len(rest) != len(body) + 4:
        raise ValueError("record length and Content-Length differ")
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records like ``samples``.

    Samples too few or too much alike to train on are themselves the dictionary, as
    raw content; without samples it is empty.
    """
    import zstandard as z

    total = sum(map(len, samples))
    if total >= 4096 and len(samples) >= 8:
        try:
            return z.train_dictionary(min(size, total // 4), samples).as_bytes()
        except z.ZstdError:
            pass
    return b"".join(samples)[-size:]


def archive_head(dictionary: bytes) -> bytes:
    """The skippable frame with the dictionary; nothing when there is none."""
    if not dictionary:
        return b""
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def read_archive(stream: io.RawIOBase) -> Iterator[bytes]:
    """Records of one archive, a frame at a time; memory holds one record."""
    import zstandard as z

    head = stream.read(8)
    dictionary, pending = b"", head
    if len(head) == 8 and int.from_bytes(head[:4], "little") == DICTIONARY_FRAME:
        dictionary = stream.read(int.from_bytes(head[4:], "little"))
        pending = b""
    context = z.ZstdDecompressor(**({"dict_data": z.ZstdCompressionDict(dictionary)} if dictionary else {}))
    while True:
        frame, out = context.decompressobj(), []
        while not frame.eof:
            if not pending and not (pending := stream.read(1 << 20)):
                if out:
                    raise ValueError("the archive ends within a record")
                return
            out.append(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def _writer(folder: str, dictionary: bytes, most: int) -> Callable:
    """Task function: writes archives, yields a manifest row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        more = {"dict_data": z.ZstdCompressionDict(dictionary)} if dictionary else {}
        context = z.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **more)
        out, name, size, n = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "first", "revisit")]
                for page, url, payload, sha1, first, revisit in zip(*columns):
                    if out is None:
                        # A name of its own for each attempt: a retried task never meets its remains.
                        name, size, n = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        size += out.write(archive_head(dictionary)) or 0
                    frame = context.compress(record(page, url, payload, sha1, first, revisit))
                    out.write(frame)
                    size, n = size + len(frame), n + 1
                    if size >= most:
                        out.close()
                        done.append((name, n, size))
                        out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        columns = list(zip(*done)) or [(), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", "records", "bytes"]
        )

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_payload: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Archive every row of ``pages`` under ``folder``; returns the manifest (archive, records, bytes).

    The payload is ``html`` in UTF-8, null is empty.  Of rows with equal payloads
    of at least ``min_payload`` bytes one with the smallest key (null last) is a
    response, also when that key repeats; all others revisit it.  Smaller
    payloads are responses.  An empty table gives an empty manifest.  Other
    columns are not read, so their names cannot clash.
    """
    payload = F.coalesce(F.encode(F.col(f"`{html}`").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{key}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("sha1"),
    )
    # Written once: the row numbers below must be the same in every use.
    rows = materialize(rows, "warc-rows", compression="zstd")
    nulls_last = "coalesce(page_id, 9223372036854775807)"
    firsts = rows.groupBy("sha1").agg(
        F.expr(f"min(struct({nulls_last} AS rank, row, page_id))").alias("f"), F.count(F.lit(1)).alias("n")
    )
    firsts, distinct = materialize_counted(firsts, "warc-firsts")
    # Only repeated payloads need their first; a hot one is looked up by broadcast.
    again = firsts.filter("n > 1")
    marked = lookup(
        rows, "sha1", again.select(F.col("sha1").alias("k"), F.col("f").alias("v")), "f",
        table_rows=again.count(), spread=["row"], limit=BROADCAST_PAYLOADS,
    )
    revisit = f"length(payload) >= {int(min_payload)} AND coalesce(row <> f.row, false)"
    marked = marked.select(
        "page_id", "url", "payload", "sha1",
        F.expr(f"if({revisit}, f.page_id, NULL)").alias("first"),
        F.expr(revisit).alias("revisit"),
    )
    dictionary = train(_excerpts(rows, firsts, distinct))
    _make_folder(pages.sparkSession, folder)
    return materialize(
        marked.mapInArrow(
            _writer(folder, dictionary, archive_bytes), "archive string, records long, bytes long"
        ),
        "warc-manifest",
    )


def _excerpts(rows: DataFrame, firsts: DataFrame, distinct: int) -> list[bytes]:
    """The beginnings of records with different payloads, those of the lowest hash.

    A cut of the hashes that about twice the sample passes comes first, so no more
    than that is ordered or sent, whatever the table.
    """
    place = F.xxhash64(F.lit(5), "sha1")
    share = min(1.0, 2 * SAMPLE_RECORDS / max(1, distinct))
    cut = int(-(1 << 63) + share * ((1 << 64) - 1))
    chosen = firsts.select(F.col("f.row").alias("row"), place.alias("place")).filter(F.col("place") <= F.lit(min(cut, (1 << 63) - 1)))
    chosen = F.broadcast(chosen.orderBy("place", "row").limit(SAMPLE_RECORDS))
    some = rows.join(chosen, "row").select(
        "row", "page_id", "url", "sha1", F.expr(f"substring(payload, 1, {EXCERPT_BYTES})").alias("payload")
    )
    some = sorted(some.collect(), key=lambda r: (r.sha1, r.row))
    return [record(r.page_id, r.url, bytes(r.payload), r.sha1, None, False) for r in some]


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)


def measured(fields: dict[str, str], http: bytes, payload: bytes) -> tuple[int, str]:
    """Length and digest of a record's payload, taken from the payload itself where it is there.

    A response that does not hold what its headers promise is refused.
    """
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != (size, digest):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is {found}, not {(size, digest)}")
    return size, digest


def _reader(folder: str, with_payload: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in HEADER.split(", ")] + ["url", "payload"] * with_payload
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        kinds += [pa.string(), pa.binary()] * with_payload
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in read_archive(stream):
                        fields, http, payload = parse(data)
                        size, digest = measured(fields, http, payload)
                        number = lambda text: int(text) if text else None
                        row = (
                            number(fields["X-Page-Id"]),
                            size,
                            digest,
                            fields["WARC-Type"],
                            number(fields.get("X-Refers-To-Page-Id", "")),
                        )
                        rows.append((*row, fields["WARC-Target-URI"], payload) if with_payload else row)
                        held += len(payload) if with_payload else 100
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def read_archives(manifest: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's archives.

    Size and digest of a response are measured on its payload; one that differs from
    its headers, a damaged frame or an archive cut short raises ValueError or
    zstandard's error, so the job fails.  A revisit has the size and digest of the
    payload that it does not repeat.
    """
    schema = HEADER + (", url string, payload binary" if with_payload else "")
    # One archive is a task's unit of work: deal them out evenly.
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = manifest.select("archive").repartition(n, "archive")
    return dealt.mapInArrow(_reader(folder, with_payload), schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared scratch space, as a URI of the file system that Spark takes it to be in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "warc"))
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return re.sub("^file:/+", "file:///", store.makeQualified(path).toString())
