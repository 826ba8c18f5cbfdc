"""WARC archives: written with an index, read back through it by coalesced byte ranges.

Writing is one pass: each task writes one archive (a gzip member per record) to the shared folder and returns the
index of what it wrote: file, offset, length, URL, digest and more per record. A task that runs twice writes a second
file under another name; the index names only the file of the attempt that counted, so lost executors do no harm.

Reading starts from the index: rows are selected there (any filter), sorted by file and offset within range
partitions of about ``task_bytes`` of the archives each, and ranges that touch or lie less than ``gap`` bytes apart are
read as one, up to ``most`` bytes at a time.

Payloads equal in SHA-1 and length, of at least ``min_bytes`` bytes, are stored once: the record of the largest page
id is a response, the others are revisits of it. Only digests are grouped; which pages revisit which goes to the tasks
that write them by input file (``in_place``), so that pages are written where they lie.

Defined results: null html is an empty payload; a null URL leaves out the target's header; line breaks in URLs are
written as %0D and %0A; pages with a null id never become the stored copy of others and revisit it as any other (if
all ids of a group are null, all are responses); rows that repeat the stored page's id are responses too; an empty
table gives an empty index; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, parts_for, shared_path
from .in_place import file_label, listed_values, pack_columns, store_keys

INDEX = "page_id long, url string, file string, offset long, length long, record_type string, refers_to long, payload_digest string, payload_bytes long"
RECORD = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
DATE = "2024-01-01T00:00:00Z"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, size: int) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{digest}|{kind}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}|{digest}|response')}>", f"WARC-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """One record as written by ``_record``: its headers (lower case), and its payload without the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:]))
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def _digest_columns() -> dict[str, Column]:
    """Digest and size of the payload, two hashes of both, and the row's file."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest, size = F.sha1(html), F.octet_length(html).cast("long")
    return {"digest": digest, "size": size, "a": F.xxhash64(digest, size), "b": F.xxhash64(F.lit(1), size, digest), "label": file_label()}


def plan_revisits(pages: DataFrame, min_bytes: int = 1000) -> str:
    """Store, for each input file, the hashes of its repeated payloads with the page that is kept of each. Returns the folder.

    ``pages`` is a stored table: its rows are found again by file.
    """
    keyed = materialize(pages.select("page_id", *[c.alias(n) for n, c in _digest_columns().items()]).where(F.col("size") >= min_bytes), "page-digests")
    keepers = keyed.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("keeper")).where("_n > 1 AND keeper IS NOT NULL")
    again = join_groups(keyed, materialize(keepers, "keepers"), ["digest", "size"], "_n", keyed.count())
    pairs = again.select("label", F.explode(F.array("a", "b")).alias("a"), F.col("keeper").alias("b"))
    return store_keys(pack_columns(pairs), "revisits")


def write_archives(pages: DataFrame, min_bytes: int = 1000, level: int = 6, path: str | None = None, stored: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files and return their index (see ``INDEX``).

    ``stored``: ``pages`` is a table as read from files; otherwise it is written to the shared folder first.
    """
    pages = pages.select("page_id", "url", "html")
    if not stored:
        pages = materialize(pages, "warc-pages")
    out = path or shared_path(pages.sparkSession, "warc")
    names = [x.split(" ")[0] for x in INDEX.split(", ")]

    revisits = plan_revisits(pages, min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(out)
        files.create_dir(root, recursive=True)
        look = listed_values(revisits)
        stream, at, name = None, 0, f"part-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            label, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "a", "b"))
            cuts, known = np.r_[0, np.flatnonzero(label[1:] != label[:-1]) + 1, len(label)], []
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    found, page = look(int(label[i]), a[i:j], b[i:j])
                    known += [int(p) if f else None for f, p in zip(found, page)]
            rows = []
            for page_id, url, html, digest, size, keeper in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size")), known):
                kind = "response" if keeper is None or keeper == page_id or size < min_bytes else "revisit"
                refers_to = None if kind == "response" else keeper
                raw = gzip.compress(_record(page_id, url, html.encode(), digest, kind, refers_to, size), level, mtime=0)
                stream = stream or files.open_output_stream(f"{root}/{name}", compression=None)
                stream.write(raw)
                rows.append((page_id, url, name, at, len(raw), kind, refers_to, digest, size))
                at += len(raw)
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
        if stream:
            stream.close()

    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), *[c.alias(n) for n, c in _digest_columns().items()])
    index = materialize(keyed.mapInArrow(write, INDEX), "warc-index")
    return index.withColumn("file", F.concat(F.lit(f"{out}/"), "file"))


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, keep_payload: bool = False, task_bytes: int = 32 << 20) -> DataFrame:
    """The records that ``index`` names (see ``RECORD``), read back from the archives; digest and size are those of the
    payload read for responses, those of the header for revisits. ``payload`` is null unless ``keep_payload``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_files: dict = {}

        def fetch(file: str, spans: list[tuple[int, int]]) -> list[tuple]:
            if file not in open_files:
                for old in open_files.values():
                    old.close()
                open_files.clear()
                files, path = fs.FileSystem.from_uri(file)
                open_files[file] = files.open_input_file(path)
            first = spans[0][0]
            data = open_files[file].read_at(spans[-1][0] + spans[-1][1] - first, first)
            rows = []
            for offset, length in spans:
                x = parse_record(gzip.decompress(data[offset - first : offset - first + length]))
                payload, kind = x["payload"], x["warc-type"]
                stored = kind == "response"
                digest = hashlib.sha1(payload).hexdigest() if stored else x["warc-payload-digest"].removeprefix("sha1:")
                size = len(payload) if stored else int(x["warc-payload-length"])
                page, refers = x.get("warc-page-id"), x.get("warc-refers-to-page")
                rows.append((None if page is None else int(page), kind, None if refers is None else int(refers), digest, size, payload if keep_payload else None))
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split(" ")[0] for x in RECORD.split(", ")])

        file, spans = None, []
        for batch in batches:
            for f, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if spans and (f != file or offset > spans[-1][0] + spans[-1][1] + gap or offset + length - spans[0][0] > most):
                    yield batch_of(fetch(file, spans))
                    spans = []
                file = f
                spans.append((offset, length))
        if spans:
            yield batch_of(fetch(file, spans))
        for f in open_files.values():
            f.close()

    # The number of tasks follows from what they read, not from the size of the index.
    parts = parts_for(index.agg(F.sum("length")).first()[0] or 0, task_bytes)
    sorted_ranges = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return sorted_ranges.mapInArrow(read, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write ``pages``, then read every record back through the index."""
    return read_records(write_archives(pages, **options))
