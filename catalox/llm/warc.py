"""WARC archives and their capture index.

Pages become WARC records in plain archives under the shared folder. Reading them
back yields one index entry per record; each archive's entries are sorted where
they are read and form a run. Runs are dealt by ranges of URL key and timestamp,
and within a range a loser tree merges them into capture histories.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalox.llm.common import materialize, scratch, tables_dir
from catalox.sources.scratch import delete

#: Payloads below this size are always stored.
REVISIT_BYTES = 1000
#: Records of one archive file and bytes of payload planned for it; they bound what a task holds when it reads one.
FILE_RECORDS, FILE_BYTES = 2000, 64 << 20
#: Entries planned for one merge range, and those of a sample that set its bounds.
RANGE_ENTRIES, RANGE_SAMPLE = 200_000, 50
KEY = ("url_key", "capture_time", "page_id")
#: Captures have no time of their own here: each id is one second after the one before, and after so many ids times start again.
FIRST_CAPTURE, CAPTURE_SECONDS = datetime(2024, 1, 1, tzinfo=UTC), 30 * 365 * 86_400
END = "\r\n\r\n"

INDEX = "url_key string, capture_time string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long"


def url_key(url: str | None) -> str:
    """The host's labels reversed, without ``www``, then the path and query in lower case."""
    if not url:
        return ")/"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")/" + url.strip().lower()
    labels = [x for x in host.split(".") if x]
    if labels and labels[0] == "www":
        labels = labels[1:]
    tail = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + tail.lower()


def _record_head(page_id, kind, url, at, digest, size, refers_to, refers_url, refers_at):
    """The header of a record as a column; a line's value cannot hold a line end."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    ident = lambda c: F.concat(F.lit("<urn:catalox:page:"), c.cast("string"), F.lit(">"))
    revisit = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", ident(refers_to)), line("WARC-Refers-To-Target-URI", clean(refers_url)), line("WARC-Refers-To-Date", refers_at))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", ident(page_id)), line("WARC-Target-URI", clean(url)),
        line("WARC-Date", at), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(kind == "revisit", revisit).otherwise(""),
        line("X-Payload-Length", size.cast("string")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))), F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str | None = None, revisit_bytes: int = REVISIT_BYTES, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> str:
    """Write a WARC record per page and return the folder of the archives.

    Of equal payloads of at least ``revisit_bytes`` the record of the largest id is
    the response and the others revisit it. Records go to archives by size, each
    class up to twice the one before, so that an archive holds about ``file_bytes``
    at most, or one larger record.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).filter("page_id is not null")
    raw = F.encode("html", "UTF-8")
    rows = rows.withColumn("size", F.length(raw).cast("long")).withColumn("digest", F.sha1(raw)).withColumn("check", F.xxhash64("html"))
    at = lambda c: F.date_format(F.timestamp_seconds(F.lit(int(FIRST_CAPTURE.timestamp())) + F.pmod(c, F.lit(CAPTURE_SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    same = ["digest", "check", "size"]
    groups = rows.filter(F.col("size") >= revisit_bytes).groupBy(*same).agg(
        F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1").select(*same, "first")
    groups = materialize(groups, "warc-groups")
    marked = rows.join(groups, same, "left").withColumn("kind", F.when(F.col("first.page_id") > F.col("page_id"), "revisit").otherwise("response"))
    head = _record_head(F.col("page_id"), F.col("kind"), F.col("url"), at(F.col("page_id")), F.col("digest"), F.col("size"), F.col("first.page_id"), F.col("first.url"), at(F.col("first.page_id")))
    path = path or f"{tables_dir(spark)}/warc-{uuid.uuid4().hex}"
    record = F.concat(head, F.when(F.col("kind") == "revisit", "").otherwise(F.col("html")))
    # Small records are one class; of each larger class fewer fit into an archive.
    small = max(1, file_bytes // file_records)
    kind = F.when(F.col("size") <= small, 0).otherwise(F.ceil(F.log2(F.col("size") / small))).cast("int")
    for k in sorted({r["kind"] for r in rows.select(kind.alias("kind")).distinct().collect()} | {0}):  # 31 classes at most
        own = marked.filter(kind == k)
        # The line separator closes each record, so a file is the records one after another.
        own.select(record.alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, file_records >> k)).option("compression", "gzip").text(path)
    return path


def _parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, payload) of each record of an archive; lengths, not separators, end the records."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        body = stop + 4
        end = body + int(head["Content-Length"])
        yield at, head, content[body:end]
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end at its length")
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives under ``path``; each archive's entries come sorted, as one run.

    Digest and length of a stored payload are taken from its bytes and must agree
    with its header; a revisit has those of the payload it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()
                entries = []
                for offset, head, payload in _parse(zlib.decompress(raw, 47) if name.endswith(".gz") else raw):
                    kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"{name}: the payload at {offset} differs from its header")
                    number = lambda key: int(head[key].rsplit(":", 1)[1].rstrip(">"))  # noqa: B023, E731
                    entries.append((
                        url_key(head["WARC-Target-URI"]), head["WARC-Date"], number("WARC-Record-ID"), head["WARC-Target-URI"], kind, digest, size,
                        number("WARC-Refers-To") if kind == "revisit" else None, name.rsplit("/", 1)[-1], offset))
                entries.sort(key=lambda e: e[:3])
                yield _entries(entries)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


_KINDS = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=_NAMES)


def loser_tree_merge(runs: list[Iterator[tuple]], key=lambda e: e[:3]) -> Iterator[tuple]:
    """Merge sorted runs. Inner nodes hold the loser of their match, so each entry replays one path of log2(k) matches."""
    k = max(1, len(runs))
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        ka, kb = key(heads[a]), key(heads[b])
        return (ka, a) < (kb, b)

    losers = [-1] * k

    def play(leaf: int) -> int:
        winner, node = leaf, (leaf + k) // 2
        while node > 0:
            if losers[node] == -1:
                losers[node] = winner
                return -1
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        return winner

    champion = -1
    for leaf in range(k):
        champion = max(champion, play(leaf))
    while heads[champion] is not None:
        yield heads[champion]
        heads[champion] = next(runs[champion], None)
        champion = play(champion)


def range_cuts(index: DataFrame, ranges: int) -> list[tuple]:
    """Keys that part the index into about equal ranges, from a sample of ``RANGE_SAMPLE`` entries a range."""
    if ranges < 2:
        return []
    every = max(1, index.count() // (ranges * RANGE_SAMPLE))
    taken = index.filter(F.pmod(F.xxhash64(*KEY), F.lit(every)) == 0).select(*KEY).orderBy(*KEY).toArrow()
    keys = list(zip(*(c.to_pylist() for c in taken.columns), strict=True))
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def merge_runs(index: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """The index in global order of (url_key, capture_time, page_id): one merge of all runs for each key range.

    Runs are cut at the ranges' bounds where they lie and move as slices that keep
    their order, so entries are sorted once, in their run.
    """
    ranges = max(1, -(-index.count() // range_entries))
    cuts = range_cuts(index, ranges)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
            archives = batch.column("archive").to_pylist()
            out, start = [], 0
            for stop in range(1, len(keys) + 1):
                if stop < len(keys) and archives[stop] == archives[start]:
                    continue
                at = start
                while at < stop:
                    k = bisect_right(cuts, keys[at])
                    end = stop if k == len(cuts) else bisect_left(keys, cuts[k], at, stop)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as writer:
                        writer.write_batch(batch.slice(at, end - at))
                    out.append((k, archives[at], *keys[at], sink.getvalue().to_pybytes()))
                    at = end
                start = stop
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["range", "archive", *KEY, "entries"])

    def entries(blobs: list[bytes]) -> Iterator[tuple]:
        for blob in blobs:
            table = pa.ipc.open_stream(blob).read_all()
            yield from zip(*(c.to_pylist() for c in table.columns), strict=True)

    def merged(runs: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in loser_tree_merge([entries(runs[name]) for name in sorted(runs)]):
            out.append(row)
            if len(out) == 10_000:
                yield _entries(out)
                out = []
        yield _entries(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, {}
        for batch in batches:
            for k, archive, blob in zip(batch.column("range").to_pylist(), batch.column("archive").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if k != now:
                    yield from merged(runs)
                    now, runs = k, {}
                runs.setdefault(archive, []).append(blob)
        yield from merged(runs)

    cut = index.mapInArrow(slices, "range int, archive string, url_key string, capture_time string, page_id long, entries binary")
    dealt = cut.repartitionByRange(len(cuts) + 1, "range").sortWithinPartitions("range", "archive", *KEY)
    return dealt.mapInArrow(run, INDEX)


def capture_histories(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and return their merged index.

    Columns: ``page_id, payload_bytes, payload_digest, record_type, refers_to,
    url_key, capture_time, url, archive, offset``. A null page is an empty payload, a null
    URL an empty one. Rows without an id are left out; rows that repeat an id have
    a record each. Equal payloads revisit only records of larger ids. Ids may be any
    number, as times start again after ``CAPTURE_SECONDS``; equal keys and times go
    by id. Pages of any length are stored whole. An empty table gives an empty
    result. Other columns are ignored, whatever their names. Archives in a ``path``
    of the caller's stay, others go when the index is written.
    """
    with scratch(pages.sparkSession):
        at = write_archives(pages, path, revisit_bytes)
        index = materialize(read_archives(pages.sparkSession, at), "warc-runs", keep=True)
        if path is None:
            delete(pages.sparkSession, at)
    return merge_runs(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "url", "archive", "offset")
