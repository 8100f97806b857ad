"""WARC archives: a writer of whole-file gzip streams, and their normaliser.

The writer deals pages out by id and writes each task's records as one gzip stream over
the whole file, as careless exporters do: no record can be read without all before it.
The normaliser inflates such a stream once, in pieces, finds the records by their
Content-Length, writes each as a gzip member of its own, and writes a sidecar index with
one line (offset, length, type, record id) for each record. Readers then seek: a task
takes a slice of an index and inflates only its members.

Files are written through pyarrow's file systems under temporary names of the attempt
and renamed when whole, so that a lost or repeated task leaves one whole file; the table
of files, not a listing, says which files count. Files are rolled at ``roll_bytes`` of
records, and no step holds more than a record and a piece of the stream.

Records with equal payloads of ``min_revisit`` bytes or more: that with the smallest
page_id is a response, the others are revisits of it (WARC-Profile
identical-payload-digest; their HTTP head keeps the full Content-Length).

Defined results of edge cases: null html is an empty payload; a null page_id sorts after
all others, so it is a revisit where its payload has another page; of repeated rows with
the smallest page_id one is the response; a null url is the target "urn:none"; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

PIECE = 1 << 18
GZIP = 31  # zlib's window bits for gzip members


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def record(kind: str, record_id: str, target: str, digest: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One uncompressed WARC record; a revisit has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {target}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, the record's bytes) of a stream of uncompressed pieces."""
    held: bytearray = bytearray()
    pieces = iter(pieces)

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not fill(looked + 1):
                raise ValueError("the archive ends within a record's head")
        headers = parse_head(bytes(held[:end]))
        size = int(headers["content-length"])
        if not fill(whole := end + 4 + size + 4):
            raise ValueError("the archive ends within a record")
        yield headers, bytes(held[end + 4 : end + 4 + size]), bytes(held[:whole])
        del held[:whole]


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The uncompressed pieces of a gzip file of one or more members."""
    z, within = zlib.decompressobj(GZIP), False
    while data := read(PIECE):
        while data:
            within = True
            if out := z.decompress(data, PIECE):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, within = z.unused_data, zlib.decompressobj(GZIP), False
    if within:
        if rest := z.flush():
            yield rest
        if not z.eof:
            raise ValueError("the archive ends within a gzip member")


class _Whole:
    """A file that counts only when it is closed well: it is written under another name and renamed."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def write_monolith(root: str, rows: Iterator[dict], roll_bytes: int) -> Iterator[str]:
    """Write records as gzip streams over whole files; yields the files' paths."""
    out = None
    for r in rows:
        if out is None:
            path = f"{root}/raw/{uuid.uuid4().hex}.warc.gz"
            out, z, held = _Whole(path), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
        data = record(**r)
        out.write(z.compress(data))
        held += len(data)
        if held >= roll_bytes:
            out.write(z.flush())
            out.close()
            out = None
            yield path
    if out is not None:
        out.write(z.flush())
        out.close()
        yield path


def _exists(uri: str) -> bool:
    system, path = open_fs(uri)
    return system.get_file_info(path).type == fs.FileType.File


def normalise(source: str, target: str) -> tuple[str, list[int]]:
    """Rewrite every record as a member of its own; returns the index's path and where the line of each record ends there.

    The index is the last to get its name. Then the source goes, so that the disk never
    holds both forms of all archives; a task that is run again finds the index and is done.
    """
    index_uri = f"{target}.idx"
    if not _exists(index_uri):
        _rewrite(source, target, index_uri)
    if _exists(source):
        system, path = open_fs(source)
        system.delete_file(path)
    system, path = open_fs(index_uri)
    with system.open_input_stream(path) as f:
        return index_uri, list(accumulate(map(len, f.read().splitlines(keepends=True))))


def _rewrite(source: str, target: str, index_uri: str) -> None:
    system, path = open_fs(source)
    out, index = _Whole(target), _Whole(index_uri)
    with system.open_input_stream(path, compression=None) as f:
        for headers, _, raw in records(inflate(f.read)):
            z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            member = z.compress(raw) + z.flush()
            line = {"offset": out.size, "length": len(member), "type": headers["warc-type"], "id": headers["warc-record-id"].strip("<>")}
            index.write((json.dumps(line) + "\n").encode())
            out.write(member)
    out.close()
    index.close()


def read_index(uri: str, start: int, size: int) -> list[dict]:
    """The lines in these bytes of an index."""
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        return [json.loads(x) for x in f.read_at(size, start).decode().splitlines()]


def read_members(archive: str, entries: list[dict]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each entry's record, read from its own member only."""
    system, path = open_fs(archive)
    with system.open_input_file(path) as f:
        for e in entries:
            raw = zlib.decompress(f.read_at(e["length"], e["offset"]), GZIP)
            yield next((h, block) for h, block, _ in records(iter([raw])))


def _page_urn(page_id: int | None, digest: str, repeat: int = 0) -> str:
    """A record's own name: the page, its payload, and which of the rows that repeat both."""
    return f"urn:page:{'' if page_id is None else page_id}:{digest}:{repeat}"


def _urn_page(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix("urn:page:").partition(":")[0]
    return int(text) if text else None


def _write(root: str, roll_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        before, repeat = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["page_id"], r["digest"])
                repeat, before = repeat + 1 if key == before else 0, key
                again = r["shared"] and not (r["refers_to"] == r["page_id"] and not repeat)
                payload = (r["html"] or "").encode()
                yield {"kind": "revisit" if again else "response", "record_id": _page_urn(*key, repeat), "target": r["url"] or "urn:none", "digest": r["digest"], "payload": payload, "refers_to": _page_urn(r["refers_to"], r["digest"]) if again else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in write_monolith(root, rows(batches), roll_bytes):
            yield pa.RecordBatch.from_pydict({"raw": [path]})

    return run


def _normalise(root: str, slice_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                target = f"{root}/members/{raw.rpartition('/')[2]}"
                index, ends = normalise(raw, target)
                cuts = [0, *ends[slice_rows - 1 :: slice_rows]]
                cuts += ends[-1:] if ends and ends[-1] > cuts[-1] else []
                slices = {"archive": [target] * (len(cuts) - 1), "idx": [index] * (len(cuts) - 1), "start": cuts[:-1], "size": [b - a for a, b in pairwise(cuts)]}
                yield pa.RecordBatch.from_pydict(slices, schema=pa.schema([("archive", pa.string()), ("idx", pa.string()), ("start", pa.int64()), ("size", pa.int64())]))

    return run


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for s in batch.to_pylist():
            out: list[tuple] = []
            for headers, block in read_members(s["archive"], read_index(s["idx"], s["start"], s["size"])):
                http, _, payload = block.partition(b"\r\n\r\n")
                page, digest = _urn_page(headers["warc-record-id"]), headers["warc-payload-digest"].removeprefix("sha256:")
                if headers["warc-type"] == "response":
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"page {page}: the payload differs from its digest")
                    out.append((page, len(payload), digest, "response", None))
                else:
                    out.append((page, int(parse_head(http)["content-length"]), digest, "revisit", _urn_page(headers["warc-refers-to"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def write_archives(spark: SparkSession, pages: DataFrame, root: str, min_revisit: int = 100, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write pages as monolithic archives below root; returns the table of files."""
    scratch = Scratch(spark, "warc-plan")
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = scratch.save(pages.select("page_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("size")), "digests")
    shared = digests.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("ref"), F.count("*").alias("n")).where("n > 1")
    # plain keys, so that the join keeps the partitioning by which pages are dealt out and the html moves once
    keys = {"k_page": F.coalesce("page_id", F.lit(-(1 << 63))), "k_digest": F.concat("digest", F.when(F.col("page_id").isNull(), "-").otherwise(""))}
    marks = digests.join(shared, "digest").withColumns(keys).select("k_page", "k_digest", F.col("ref").alias("refers_to"), F.lit(True).alias("shared")).distinct()
    # digests repeat over many pages, so the page id leads in dealing rows out
    own = pages.select("page_id", "url", "html", F.sha2(raw, 256).alias("digest")).withColumns(keys).repartition(shuffle_partitions(spark), "k_page", "k_digest")
    both = own.join(marks, ["k_page", "k_digest"], "left").sortWithinPartitions("k_page", "k_digest")
    dealt = both.select("page_id", "url", "html", "digest", "refers_to", F.coalesce("shared", F.lit(False)).alias("shared"))
    return scratch.save(dealt.mapInArrow(_write(root, roll_bytes), "raw string"), "files")


def normalise_archives(spark: SparkSession, files: DataFrame, root: str, slice_rows: int = 2000) -> DataFrame:
    """Rewrite monolithic archives record by record; returns slices of the sidecar indexes."""
    scratch = Scratch(spark, "warc-index")
    spread = files.repartition(shuffle_partitions(spark))
    return scratch.save(spread.mapInArrow(_normalise(root, slice_rows), "archive string, idx string, start long, size long"), "slices")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write archives, normalise them, and read every record back through the index."""
    root = Scratch(spark, "warc").root
    slices = normalise_archives(spark, write_archives(spark, pages, root), root)
    return slices.repartition(shuffle_partitions(spark)).mapInArrow(_read, READ_SCHEMA)
