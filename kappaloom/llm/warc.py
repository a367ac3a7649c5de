"""WARC archives and their index: locally sorted capture runs, merged by loser trees.

Every writing task makes an archive of gzip members, one for each record, and a
run: the archive's index lines sorted by URL key and timestamp. Runs are divided
at common splitter keys, within a URL's captures too; a task takes one key range of all runs, which it reads
sequentially, and merges them with a loser tree. Beyond FAN_IN runs, groups of
runs are first merged to longer ones. The ranges, in order, are the capture history.

Files get a name of their own in every attempt, and only those of the attempt that
succeeded are listed in the table of runs.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, opened, staged

#: Bytes after which a task begins another archive; runs that a merge reads at once; lines whose keys are told of a run, at most.
ARCHIVE_BYTES, FAN_IN, TOLD = 256 << 20, 256, 64
#: Lines of a range of the history that are aimed at, and splitter keys that are looked at, at most.
RANGE_LINES, SAMPLE = 1 << 20, 100_000
BLANK = re.compile(r"[\x00-\x20\x7f]")
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """The sort key of a URL: reversed host, path and query in lower case, without scheme, www, default port and fragment.

    >>> url_key("https://WWW.Example.org:443/A?b#c"), url_key("http://[::1"), url_key(None)
    ('org,example)/a?b', ')http://[::1', ')/')
    """
    # blanks and line ends would break the index's lines
    text = BLANK.sub(lambda m: f"%{ord(m[0]):02x}", (url or "").strip())
    try:
        parts = urlsplit(text if "//" in text else f"//{text}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return ")" + text.lower()
    host = host.removeprefix("www.")
    shown = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(host.split("."))) + shown + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, when: datetime) -> bytes:
    """A WARC record; a revisit keeps the HTTP head, whose length is that of the full payload, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        # a line break can't stand in a header
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """The headers, the HTTP head and the payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def members(url: str, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of every gzip member of an archive, read sequentially."""
    system, path = opened(url)
    with system.open_input_stream(path) as file:
        held, begin = file.read(chunk), 0
        while held:
            member, parts, size = zlib.decompressobj(31), [], 0
            while not member.eof:
                parts.append(member.decompress(held))
                size += len(held) - len(member.unused_data)
                held = member.unused_data or b""
                if not member.eof:
                    held = file.read(chunk)
                    if not held:
                        raise ValueError(f"{url}: cut at {begin}")
            yield begin, size, b"".join(parts)
            begin += size
            held = held or file.read(chunk)


class LoserTree:
    """Merges sorted iterators: every inner node keeps the loser of its match, the winner moves up; one match a level replaces it.

    >>> list(LoserTree([iter([1, 4]), iter([]), iter([1, 2, 9])]))
    [(1, 0), (1, 2), (2, 2), (4, 0), (9, 2)]
    """

    def __init__(self, runs: list[Iterator], key: Callable = lambda x: x) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads: list = [None] * self.k
        self.items: list = [None] * self.k
        for i in range(self.k):
            self._advance(i)
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _advance(self, i: int) -> None:
        item = next(self.runs[i], None)
        self.items[i] = item
        # an ended run loses against all; ties go to the earlier run
        self.heads[i] = (True,) if item is None else (False, self.key(item), i)

    def _enter(self, i: int) -> None:
        """While the tree is filled: wait at the first empty node, or play on."""
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self.heads[other] < self.heads[i]:
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            i = self.losers[0]
            if self.items[i] is None:
                return
            yield self.items[i], i
            self._advance(i)
            node = (i + self.k) // 2
            while node:
                other = self.losers[node]
                if self.heads[other] < self.heads[i]:
                    self.losers[node], i = i, other
                node //= 2
            self.losers[0] = i


def line_of(entry: dict) -> bytes:
    return f"{entry['url_key']} {entry['captured']} {json.dumps(entry, ensure_ascii=True, separators=(',', ':'))}\n".encode("utf-8", "surrogatepass")


#: What lines are sorted by: URL key and timestamp, then what makes the order total, so that a URL's captures, however many, can be divided.
KEY = {"url_key": pa.string(), "captured": pa.string(), "archive": pa.string(), "offset": pa.int64()}


def sort_key(entry: dict) -> tuple:
    return tuple(entry[name] for name in KEY)


def write_run(folder: str, entries: Iterator[dict]) -> tuple[str, int, list[dict]]:
    """Write sorted entries as a run: its url, the number of lines, and the keys of at most TOLD evenly spaced lines."""
    system, path = opened(folder)
    name = f"{uuid.uuid4().hex}.cdxj"
    n, step, keys = 0, 1, []
    with system.open_output_stream(f"{path}/{name}") as out:
        for entry in entries:
            if n % step == 0:
                keys.append({name: entry[name] for name in KEY})
                if len(keys) > TOLD:
                    keys, step = keys[::2], 2 * step
            out.write(line_of(entry))
            n += 1
    return f"{folder}/{name}", n, keys


def _entry(line: bytes) -> dict:
    return json.loads(line[line.index(b" {") + 1 :])


def _next_line(file, at: int, chunk: int = 4096) -> tuple[int, bytes]:  # noqa: ANN001
    """Where the first line at or behind `at` begins, and the line; an empty one at the end. A line begins at 0 or behind a feed."""
    size, begin = file.size(), at
    if at:
        while True:
            data = file.read_at(min(chunk, size - begin + 1), begin - 1)
            if (found := data.find(b"\n")) >= 0:
                begin += found
                break
            begin += len(data)
            if begin > size:
                return size, b""
    line, end = b"", begin
    while end < size and b"\n" not in line:
        line += file.read_at(min(chunk, size - end), end)
        end = begin + len(line)
    return begin, line.partition(b"\n")[0]


def first_line(file, low: tuple) -> int:  # noqa: ANN001
    """The offset of a run's first line whose key is not below low, by halving the file."""
    left, right = 0, file.size()
    while left < right:
        middle = (left + right) // 2
        begin, line = _next_line(file, middle)
        if line and sort_key(_entry(line)) < low:
            left = begin + 1
        else:
            right = middle
    return _next_line(file, left)[0]


def read_run(url: str, low: tuple | None = None, high: tuple | None = None, chunk: int = 1 << 20) -> Iterator[dict]:
    """The entries with low <= key < high, read sequentially."""
    system, path = opened(url)
    with system.open_input_file(path) as file:
        file.seek(first_line(file, low) if low is not None else 0)
        rest = b""
        while data := file.read(chunk):
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                entry = _entry(line)
                if high is not None and sort_key(entry) >= high:
                    return
                yield entry


_STRUCT = "struct<url_key:string,captured:string,archive:string,offset:bigint>"
RUN = f"url string, lines long, keys array<{_STRUCT}>"
_RUN = pa.schema([("url", pa.string()), ("lines", pa.int64()), ("keys", pa.list_(pa.struct(list(KEY.items()))))])


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to): the pages whose payload, of at least least_bytes, a page with a larger id has too."""
    thin = pages.where(F.octet_length("html") >= least_bytes).select("page_id", "sha")
    last = thin.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return thin.join(last, "sha").where("page_id IS NULL OR page_id < refers_to").select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html); returns the table of archives with their sorted runs.

    A null html is an empty payload, a null url an empty one. Of equal payloads the
    one with the largest page_id is a response and the others revisit it; a page
    without an id revisits it too; rows that share the largest id are all responses.
    """
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    again = staged(revisits(full, least_bytes), "revisits")  # its size is known then: Spark broadcasts it only if it is small
    paired = full.alias("p").join(again.alias("r"), F.expr("p.page_id <=> r.page_id AND p.sha = r.sha"), "left").select("p.page_id", "p.url", "p.html", "r.refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        made, entries, out, name, at = [], [], None, "", 0

        def close() -> None:
            out.close()
            made.append((f"{folder}/{name}", *write_run(folder, sorted(entries, key=sort_key))))
            entries.clear()

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}")
                when = EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, when)) + packer.flush()
                out.write(data)
                entries.append({"url_key": url_key(url), "captured": f"{when:%Y%m%d%H%M%S}", "page_id": page_id, "archive": name, "offset": at, "length": len(data)})
                at += len(data)
        if out:
            close()
        columns = [list(c) for c in zip(*made, strict=True)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *(f.type for f in _RUN)], strict=True)], ["archive", *_RUN.names])

    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return staged(paired.mapInArrow(write, f"archive string, {RUN}"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(archive, offset, page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record, read from the archives."""
    kinds = [("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column("archive").to_pylist():
                rows = []
                for begin, _, data in members(url):
                    if len(rows) == 10_000:
                        yield batched(rows)
                        rows = []
                    headers, http, payload = parse(data)
                    said, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    length = int(http.rsplit(b"Content-Length: ", 1)[1])
                    if kind == "response" and (len(payload) != length or digest(payload) != said):
                        raise ValueError(f"{url}: the record at {begin} is damaged")
                    number = lambda key: int(headers[key]) if headers.get(key) else None
                    rows.append((url.rsplit("/", 1)[1], begin, number("X-Page-ID"), headers["WARC-Target-URI"], length, said, kind, number("X-Refers-To-Page")))
                yield batched(rows)

    names = archives.select("archive")
    return names.repartition(max(1, names.count()), F.xxhash64("archive")).mapInArrow(read, "archive string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _merged(runs: DataFrame, jobs: DataFrame, folder: str) -> DataFrame:
    """For each job (job, low, high, part of runs): its runs' entries of the key range, merged and written as one run."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, high = (row[x] and sort_key(row[x]) for x in ("low", "high"))
                parts = [read_run(url, low, high) for url in sorted(row["runs"])]
                url, n, keys = write_run(folder, (entry for entry, _ in LoserTree(parts, sort_key)))
                yield pa.RecordBatch.from_arrays([pa.array([row["job"]], pa.int64()), *(pa.array([v], t.type) for v, t in zip((url, n, keys), _RUN, strict=True))], ["job", *_RUN.names])

    dealt = runs.groupBy("part").agg(F.collect_list("url").alias("runs")).join(jobs, "part").drop("part")
    return staged(dealt.repartition(max(1, jobs.count()), "job").mapInArrow(merge, f"job long, {RUN}"), "merged")


def merge_runs(runs: DataFrame, folder: str, fan_in: int = FAN_IN, range_lines: int = RANGE_LINES) -> DataFrame:
    """Merge the runs (RUN) to a history: (range, RUN), where the ranges in order hold all entries in order.

    A task holds the names of at most fan_in runs and a buffer for each.
    """
    spark = runs.sparkSession
    runs = runs.select("url", "lines", "keys")
    none = f"CAST(NULL AS {_STRUCT})"
    while (n := runs.count()) > fan_in:
        grouped = runs.selectExpr("*", f"pmod(xxhash64(url), {-(-n // (fan_in // 2 or 1))}) AS part")
        runs = _merged(grouped, grouped.selectExpr("part").distinct().selectExpr("part", "part AS job", f"{none} AS low", f"{none} AS high"), folder).drop("job")
    lines = runs.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    wanted = max(1, -(-lines // range_lines), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sample = sorted(tuple(r[0]) for r in runs.select(F.explode("keys").alias("key")).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect())
    cuts = sorted({sample[len(sample) * i // wanted] for i in range(1, wanted)}) if sample else []
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    jobs = spark.createDataFrame([(0, i, low, high) for i, (low, high) in enumerate(bounds)], f"part int, job long, low {_STRUCT}, high {_STRUCT}")
    return _merged(runs.withColumn("part", F.lit(0)), jobs, folder).withColumnRenamed("job", "range")


def read_history(history: DataFrame) -> DataFrame:
    """(archive, offset, url_key, captured, position): the merged index, position from 0 in the whole history."""
    begun = history.selectExpr("url", "sum(lines) over (order by range) - lines AS start")  # one row a range

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("archive", "offset", "url_key", "captured")
        for batch in batches:
            for row in batch.to_pylist():
                at, entries = row["start"], read_run(row["url"])
                while found := list(islice(entries, 10_000)):
                    columns = [[e[c] for e in found] for c in names]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64() if k == "offset" else pa.string()) for k, c in zip(names, columns, strict=True)), pa.array(range(at, at + len(found)), pa.int64())], [*names, "position"])
                    at += len(found)

    return begun.repartition(max(1, history.count()), "url").mapInArrow(read, "archive string, offset long, url_key string, captured string, position long")


def capture_table(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back, with each record's place in the capture history.

    A null html is an empty payload; null ids and urls are records too. Repeated rows give repeated records, and ties of key and time
    are ordered by archive and offset; payloads of any length are one record; an empty table gives none; other columns, whatever
    their names, are left out.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, least_bytes)
    history = merge_runs(archives, folder)
    # both sides grow out of short tables of files; Spark would take them for small ones and broadcast one
    return read_archives(archives).hint("merge").join(read_history(history), ["archive", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "url_key", "captured", "position", "archive", "offset")
