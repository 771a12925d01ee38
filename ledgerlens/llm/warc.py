"""WARC archives with a two-level capture index.

Writing: every task writes one WARC 1.1 file of gzip members (one per record) into
the shared folder, streaming, under a name of its own; the rows it returns name the
file, so files of lost or repeated attempts are never referred to. Captures are then
range-sorted by reversed-host key; each range becomes one index file of compressed
blocks of ``BLOCK_LINES`` lines, which ends in its own sparse directory: every block's first
key, offset and length. A table of the index files (a row per range) names their
first and last keys and where their directories are.

Reading: look-ups are sorted by key and dealt in the same order. A task opens the
index files of its keys alone: it binary-searches the files, reads the one's directory, binary-searches
that, range-reads and unpacks single blocks, finds its lines, range-reads the records
and parses them.

Duplicates: among payloads of at least ``MIN_REVISIT`` bytes with one SHA-1, the
largest page_id is the response, the others are revisit records (identical payload)
without a payload.

The files lie in ``spark.checkpoint.dir`` and are opened with pyarrow's file systems
(local, HDFS, S3 by scheme).

Edge cases: null html is an empty payload, a null url an empty one. Payloads are written
whole at any length. Rows that repeat
a page_id: equal ones are each written and read; of equal payloads with the same
largest page_id all such rows are responses. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import arrow_pass, materialize, scratch_path

MIN_REVISIT = 1000
#: Lines of an index block, and the level of compression.
BLOCK_LINES, LEVEL = 1000, 4
#: Unpacked index blocks and open archives that a reading task keeps.
KEEP_BLOCKS, KEEP_FILES = 4, 64
#: Ways that the copies of one payload are dealt when they meet their response.
SALTS = 16
#: A fixed WARC-Date, so that archives are reproducible.
DATE = "2024-01-01T00:00:00Z"


def reversed_host_key(url: str) -> str:
    """``https://www.a.example/p?q`` -> ``example,a)/p?q``: sorts a host's captures together."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){(parts.path or '/').lower()}" + (f"?{parts.query.lower()}" if parts.query else "")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def _record(kind: str, page: int | None, url: str, digest: str, size: int, payload: bytes | None, refers: int | None) -> bytes:
    """One gzip member: WARC headers, HTTP headers, payload (none in a revisit)."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    else:
        block += payload or b""
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse_record(member: bytes) -> dict[str, object]:
    """Headers and payload of a gzip member; a response's digest and size come from its payload."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    out: dict[str, object] = {"record_type": kind, "url": fields["WARC-Target-URI"], "refers_to": None}
    own = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    out["page_id"] = None if own == "None" else int(own)
    if kind == "revisit":
        size = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
        out |= {"payload_bytes": int(size.split(": ")[1]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
        out["refers_to"] = int(fields["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
    else:
        out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}
        if out["payload_digest"] != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
            raise ValueError(f"payload of page {own} doesn't match its digest")
    return out


CAPTURES = "urlkey string, page_id long, file string, offset long, length long, kind string, digest string"
INDEX_FILES = "first_key string, first_page long, last_key string, last_page long, file string, offset long, length long"


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write the records; returns the captures (urlkey, page_id, file, offset, length, kind, digest)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    digest, size = F.sha1(F.col("html").cast("binary")), F.octet_length("html").cast("long")
    marked = rows.withColumn("digest", digest).withColumn("size", size)
    # One row per repeated payload: small unless most pages repeat; copies of one payload pre-aggregate.
    repeated = (
        marked.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "last")
    )
    repeated = materialize(repeated, "repeated").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Salted, so that a payload that a third of all pages share doesn't meet in one task.
    marked = marked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    ready = marked.join(repeated, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", "size", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = f"{root}/archive-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    got = []
                    for r in batch.slice(lo, 512).to_pylist():
                        if out is None:
                            fs, path = filesystem(name)
                            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                            out = fs.open_output_stream(path, compression=None)
                        again = r["last"] is not None and r["page_id"] is not None and r["page_id"] != r["last"]
                        kind = "revisit" if again else "response"
                        member = _record(kind, r["page_id"], r["url"], r["digest"], r["size"], r["html"].encode(), r["last"])
                        out.write(member)
                        got.append((reversed_host_key(r["url"]), r["page_id"], name, at, len(member), kind, r["digest"]))
                        at += len(member)
                    if got:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                            names=["urlkey", "page_id", "file", "offset", "length", "kind", "digest"],
                        )
        finally:
            if out is not None:
                out.close()

    # Written at once: the rows that stay name the files of the attempts that counted.
    return materialize(arrow_pass(ready, run, CAPTURES), "captures")


def _partitions(df: DataFrame) -> int:
    """The session's shuffle partitions, to be named where AQE would merge ranges of small rows that mean much work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_index(captures: DataFrame, root: str, directory: str) -> None:
    """Sort captures by key into files of compressed blocks; writes the table of the files at ``directory``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = f"{root}/index-{uuid.uuid4().hex}.cdx.gz", None, 0
        lines: list[tuple] = []
        blocks: list[tuple] = []
        last: tuple = ()

        def put(rows: list[tuple]) -> int:
            """Append rows as a compressed member; its length."""
            nonlocal out, at
            if out is None:
                fs, path = filesystem(name)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            member = gzip.compress("\n".join(json.dumps(x) for x in rows).encode(), LEVEL, mtime=0)
            out.write(member)
            at += len(member)
            return len(member)

        def flush() -> None:
            begin = at
            blocks.append((*lines[0][:2], begin, put(lines)))
            lines.clear()

        try:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("urlkey", "page_id", "file", "offset", "length")), strict=True):
                    lines.append(row)
                    last = row[:2]
                    if len(lines) == BLOCK_LINES:
                        flush()
            if lines:
                flush()
            if blocks:
                begin = at
                entry = (*blocks[0][:2], *last, name, begin, put(blocks))
        finally:
            if out is not None:
                out.close()
        if blocks:
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(entry, types, strict=True)], names=["first_key", "first_page", "last_key", "last_page", "file", "offset", "length"])

    # page_id is part of the sort key, so one very common host or address still spreads over ranges.
    spread = captures.repartitionByRange(_partitions(captures), "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id")
    spread.mapInArrow(run, INDEX_FILES).write.parquet(directory)


def _order(key: str, page: int | None) -> tuple[bytes, bool, int]:
    """Spark's order of (urlkey, page_id): UTF-8 bytes, nulls first."""
    return key.encode(), page is not None, page or 0


class Directory:
    """The index files by their keys (a row per range), and the sparse directories of those in use."""

    def __init__(self, path: str, read) -> None:
        fs, at = filesystem(path)
        rows = ds.dataset(at, filesystem=fs, format="parquet").to_table().to_pylist()
        self.files = sorted(rows, key=lambda r: _order(r["first_key"], r["first_page"]))
        self.last = [_order(r["last_key"], r["last_page"]) for r in self.files]
        self.read = read
        self.held: dict[str, tuple[list, list]] = {}

    def _blocks(self, file: dict) -> tuple[list, list]:
        """(first keys, entries) of a file's blocks."""
        name = file["file"]
        if name not in self.held:
            while len(self.held) >= KEEP_BLOCKS:
                self.held.pop(next(iter(self.held)))
            entries = [json.loads(x) for x in gzip.decompress(self.read(name, file["offset"], file["length"])).decode().split("\n")]
            self.held[name] = [_order(*e[:2]) for e in entries], entries
        return self.held[name]

    def blocks(self, key: str, page: int | None) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that may hold (key, page)."""
        want = _order(key, page)
        at = bisect.bisect_left(self.last, want)
        while at < len(self.files) and _order(self.files[at]["first_key"], self.files[at]["first_page"]) <= want:
            keys, entries = self._blocks(self.files[at])
            # The last block that begins before it, and all that begin with it.
            i = max(0, bisect.bisect_left(keys, want) - 1)
            while i < len(keys) and keys[i] <= want:
                yield self.files[at]["file"], *entries[i][2:]
                i += 1
            at += 1


class Archives:
    """Look-ups through a directory, with a few blocks and open archives at hand."""

    def __init__(self, directory: str) -> None:
        self.directory = Directory(directory, self._read)
        self.blocks: dict[tuple[str, int], dict] = {}
        self.files: dict[str, pa.NativeFile] = {}

    def _block(self, entry: tuple[str, int, int]) -> dict:
        place = entry[:2]
        if place not in self.blocks:
            while len(self.blocks) >= KEEP_BLOCKS:
                self.blocks.pop(next(iter(self.blocks)))
            lines: dict = {}
            for line in gzip.decompress(self._read(*entry)).decode().split("\n"):
                key, page, *where = json.loads(line)
                lines.setdefault((key, page), []).append(where)
            self.blocks[place] = lines
        return self.blocks[place]

    def _read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            while len(self.files) >= KEEP_FILES:
                self.files.pop(next(iter(self.files))).close()
            fs, path = filesystem(name)
            self.files[name] = fs.open_input_file(path)
        return self.files[name].read_at(length, offset)

    def records(self, key: str, page: int | None) -> list[dict[str, object]]:
        return [
            parse_record(self._read(*where)) for entry in self.directory.blocks(key, page) for where in self._block(entry).get((key, page), [])
        ]

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def read_archives(wanted: DataFrame, directory: str, payloads: bool = False) -> DataFrame:
    """Look each (urlkey, page_id) up through the index and parse its records.

    One row per record found: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and with ``payloads`` the payload (null in a revisit).
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives: Archives | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                archives = archives or Archives(directory)
                part = batch.slice(lo, 512)
                keys = zip(part.column("urlkey").to_pylist(), part.column("page_id").to_pylist(), strict=True)
                found = [r for key, page in keys for r in archives.records(key, page)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], t) for n, t in zip(names, types, strict=False)], names=names)
        if archives is not None:
            archives.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return wanted.select("urlkey", "page_id").mapInArrow(run, schema + (", payload binary" if payloads else ""))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, and read every record back through the index."""
    root = scratch_path(pages.sparkSession, "warc")
    captures = write_archives(pages, root)
    directory = f"{root}-directory"
    write_index(captures, root, directory)
    # Asked in the order of the index, so a task's look-ups touch neighbouring blocks.
    wanted = captures.select("urlkey", "page_id").distinct()
    return read_archives(wanted.repartitionByRange(_partitions(wanted), "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id"), directory)
