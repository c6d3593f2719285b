"""WARC archives and their capture index by external merge.

``write_archives`` turns rows into WARC/1.1 records, one gzip member each, in archive files of bounded size in the
shared folder.  Equal payloads are stored once: the record with the largest id is a ``response``, the others are
``revisit`` records that refer to it.  ``read_archives`` reads the files back, record by record, and emits each file's
captures as one locally sorted run.  ``merge_runs`` merges all runs by (URL key, timestamp, id): ranges of the key space
are dealt to tasks, and each task merges its part of every run through a loser tree, which gives globally ordered
capture histories without any task sorting or holding the whole index.

A task that is lost and run again writes files of new names; only files named in the stored manifest count.

Defined cases: a null payload is an empty one; a null url gives no target URI and the empty URL key; a null timestamp is
1970-01-01T00:00:00Z; a row without id is always a response; repeated rows each get a record, and all repeats of the row with the largest id are responses; an empty table gives no
archive and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from math import ceil
from urllib.parse import quote, urlsplit

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20
#: Captures that a merging task holds, of about 1 kB each in Python.
RANGE_ROWS = 200_000
_ID = "urn:x-record:"

CAPTURE_SCHEMA = ("urlkey string, ts timestamp, record_id long, url string, payload_bytes long, payload_digest string, "
                  "record_type string, refers_to long, archive string, offset long, length long, run string, pos long")


def url_key(url: str | None) -> str:
    """Sortable key of a URL: host labels from the right, then path and sorted query; scheme, ``www.``, default
    ports, user and fragment do not matter."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = host.removeprefix("www.")
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{where}){parts.path.lower() or '/'}" + (f"?{query.lower()}" if query else "")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _stamp(ts) -> str:
    if ts is None or pd.isna(ts):
        return "1970-01-01T00:00:00Z"
    return pd.Timestamp(ts).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _id_text(i) -> str:
    return f"<{_ID}{'none:' + uuid.uuid4().hex if i is None or pd.isna(i) else int(i)}>"


def _id_value(text: str | None) -> int | None:
    tail = (text or "").strip("<>").removeprefix(_ID)
    return int(tail) if tail and not tail.startswith("none:") else None


def record_bytes(record_id, url, ts, payload: bytes, refers_to) -> bytes:
    """One uncompressed WARC record; ``refers_to`` makes it a revisit without payload."""
    revisit = refers_to is not None and not pd.isna(refers_to)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id_text(record_id)}",
            f"WARC-Date: {_stamp(ts)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if revisit:
        head += [f"WARC-Refers-To: {_id_text(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters of a URI that stand in a header as they are; others are percent-encoded.
_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers in lower case, payload, length of the whole payload) of one record; a revisit's payload is empty and
    its length is what its HTTP header says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, payload, said


def write_archives(df: DataFrame, record_id: str, url: str, ts: str, payload: str, min_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row; the stored manifest (archive, records, bytes) names the files.
    Payloads of fewer than ``min_bytes`` bytes are never revisits."""
    spark = df.sparkSession
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(record_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(ts).cast("timestamp").alias("ts"),
                     body.alias("payload"), F.unhex(F.sha1(body.cast("binary"))).alias("digest"))
    # Copies of a payload are found by digest and id alone (summed before they move); few payloads have any.
    copied = (rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest")
              .agg(F.max("id").alias("newest"), F.count("*").alias("n")).filter("n > 1 AND newest IS NOT NULL").drop("n"))
    rows = rows.join(copied, "digest", "left").withColumn("refers_to", F.when(F.col("id") < F.col("newest"), F.col("newest")))
    folder = scratch_path(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = open_fs(folder)
        files.create_dir(base, recursive=True)
        attempt, sink, written = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", None, []
        try:
            for b in batches:
                for i, u, t, body, ref in zip(b["id"], b["url"], b["ts"], b["payload"], b["refers_to"]):
                    if sink is None:
                        name = f"part-{attempt}-{len(written):05d}.warc.gz"
                        sink = files.open_output_stream(f"{base}/{name}", compression=None)
                        written.append([f"{folder}/{name}", 0, 0])
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record_bytes(i, u, t, body.encode(), ref)) + packer.flush()
                    sink.write(data)
                    written[-1][1] += 1
                    written[-1][2] += len(data)
                    if written[-1][2] >= archive_bytes:
                        sink.close()
                        sink = None
        finally:
            if sink is not None:
                sink.close()
        yield pd.DataFrame(written, columns=["archive", "records", "bytes"])

    return stored(rows.select("id", "url", "ts", "payload", "refers_to").mapInPandas(write, "archive string, records long, bytes long"), "manifest")


def archive_records(path: str, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, record) of each gzip member of an archive, read as a stream."""
    files, at = open_fs(path)
    with files.open_input_stream(at, compression=None) as source:
        offset, pending = 0, source.read(chunk)
        while pending:
            unpack, record, used = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                if not pending:
                    raise EOFError(f"{path} ends inside the record at {offset}")
                record.append(unpack.decompress(pending))
                used += len(pending) - len(unpack.unused_data)
                pending = unpack.unused_data or (b"" if unpack.eof else source.read(chunk))
            yield offset, used, b"".join(record)
            offset += used
            pending = pending or source.read(chunk)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Capture runs: the records of each archive, checked against their digests and sorted by (urlkey, ts, id).  One
    archive is one run and one unit of work; its records are read as a stream and only their index lines are kept."""
    archives = manifest.select("archive")
    n = max(1, archives.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["archive"]:
                lines = []
                for offset, length, data in archive_records(path):
                    h, payload, whole = parse_record(data)
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    kind = h["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{path}: the payload at {offset} does not match its digest")
                    url = h.get("warc-target-uri")
                    ts = datetime.fromisoformat(h["warc-date"].replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)
                    lines.append((url_key(url), ts, _id_value(h["warc-record-id"]), url, whole, digest, kind,
                                  _id_value(h.get("warc-refers-to")), path, offset, length))
                lines.sort(key=_order)
                out = pd.DataFrame([(*x, path, k) for k, x in enumerate(lines)], columns=[c.split()[0] for c in CAPTURE_SCHEMA.split(", ")])
                for c in ("record_id", "refers_to"):
                    out[c] = out[c].astype("Int64")
                yield out

    # By range, since hashes put several archives into one task and none into others.
    return stored(archives.repartitionByRange(n, "archive").mapInPandas(read, CAPTURE_SCHEMA), "runs")


def _order(line: tuple) -> tuple:
    """(urlkey, ts, id) with records without id first, then by place."""
    return line[0], line[1], line[2] is not None, line[2] or 0, line[8], line[9]


class LoserTree:
    """K-way merge of sorted iterators: inner nodes hold the losers of their matches, so each next item costs one
    match per level on the way from its leaf to the root."""

    def __init__(self, sources: list[Iterable], key):
        self.key, self.sources = key, [iter(s) for s in sources]
        self.k = len(self.sources)
        self.items = [next(s, None) for s in self.sources]
        self.keys = [None if x is None else key(x) for x in self.items]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:  # the first to arrive waits for its opponent
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.keys[winner := self.losers[0]] is not None:
            yield self.items[winner]
            self.items[winner] = x = next(self.sources[winner], None)
            self.keys[winner] = None if x is None else self.key(x)
            self._play(winner)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All runs merged: ``range`` (task, ascending with the key), ``seq`` (place in it) and the captures.  Ordered by
    (range, seq) the rows are in order of (urlkey, ts, id).  There are at least as many ranges as it takes to give each
    about ``range_rows`` captures, so what a task holds of the runs does not grow with them."""
    schema = f"range int, seq long, {CAPTURE_SCHEMA}"
    names = [c.split()[0] for c in schema.split(", ")]
    # The unique place of a record ends the key, so a URL or host with a third of all captures spreads over ranges too.
    place, ranges = ["urlkey", "ts", "record_id", "archive", "offset"], ceil(runs.count() / range_rows)
    many = ranges > int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(ranges, *place) if many else runs.repartitionByRange(*place)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[str, list[tuple]] = {}
        for b in batches:
            b = b.astype({"record_id": object, "refers_to": object})
            b = b.where(b.notna(), None)
            for line in b.itertuples(index=False, name=None):
                parts.setdefault(line[11], []).append(line)
        for lines in parts.values():  # blocks of one run may arrive out of turn
            lines.sort(key=lambda x: x[12])
        here, block, seq = TaskContext.get().partitionId(), [], 0
        for line in LoserTree([parts[r] for r in sorted(parts)], _order):
            block.append((here, seq, *line))
            seq += 1
            if len(block) == 10_000:
                yield _frame(block, names)
                block = []
        if block:
            yield _frame(block, names)

    return dealt.mapInPandas(merge, schema)


def _frame(block: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(block, columns=names)
    for c in ("record_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def capture_history(df: DataFrame, record_id: str, url: str, ts: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Write archives, read them back, and return the merged capture index."""
    return merge_runs(read_archives(write_archives(df, record_id, url, ts, payload, min_bytes)))
