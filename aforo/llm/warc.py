"""WARC archives: write pages as records, index them, read byte ranges back.

The index comes first: writing yields offset, length, URL and digest of every
record. A read selects rows of the index, sorts them by file and offset and
joins neighbours whose gap is small into one range, so a file is read in few
requests however the records were chosen.

Records are gzip members of their own, as the format recommends. Payloads that
occur more than once are stored once: the page with the smallest id of those
with the same digest gets a ``response`` record, the others a ``revisit``.
Payloads under ``least_bytes`` are always responses.

Null payload: empty. Null URL: an empty target. Null id: kept; it is the first
of its group only if all ids there are null. Rows that repeat an id with the
same payload are responses all. Empty table: no files, no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import new_file, open_fs, pick, stored

INDEX_SCHEMA = (
    "file string, offset long, length long, url string, page_id long, record_type string, payload_digest string"
)
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
    "refers_to long, stored_bytes long, intact boolean"
)
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to to ``(page_id, url, payload)``.

    First pages by digest are counted map-side and stored; the join on the
    digest then has two plain shuffled sides, whose hot keys Spark can split.
    """
    body = F.coalesce(F.col("payload"), F.lit(""))
    sized = pages.withColumns(
        {"payload": body, "payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha2(body, 256)}
    )
    keyed = sized.filter(F.col("payload_bytes") >= least_bytes).select("payload_digest", "page_id")
    first = keyed.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = stored(first.filter("_n > 1").drop("_n"), "warc-first")
    joined = sized.join(first, "payload_digest", "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.col("payload_bytes") >= least_bytes)
    return joined.withColumns(
        {"record_type": F.when(other, "revisit").otherwise("response"), "refers_to": F.when(other, F.col("_first"))}
    ).drop("_first")


def _record(row: dict) -> bytes:
    """One WARC/1.1 record; extension headers start with ``X-``."""
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else row["payload"].encode()
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    name = "null" if row["page_id"] is None else row["page_id"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _parse(data: bytes) -> tuple[dict, bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields, rest[:size]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]
    )


def write_archives(marked: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """One archive per task; returns the stored index, a row per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        name, out, offset = new_file(folder, TaskContext.get().partitionId(), "warc.gz"), None, 0
        done = []
        for batch in batches:
            if out is None and len(batch):
                fs.create_dir(open_fs(folder)[1], recursive=True)
                out = fs.open_output_stream(open_fs(name)[1], compression=None)
            index = []
            for row in batch.to_pylist():
                data = gzip.compress(_record(row), level, mtime=0)
                out.write(data)
                index.append((name, offset, len(data), row["url"], row["page_id"], row["record_type"], row["payload_digest"]))
                offset += len(data)
            done.append(_batch(index, INDEX_SCHEMA))
        if out is not None:
            out.close()
        yield from done  # only now the file is whole

    return stored(marked.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_records(index: DataFrame, gap: int = 1 << 16, longest: int = 1 << 24, payloads: bool = False) -> DataFrame:
    """The records that ``index`` rows name, with sorted ranges joined.

    Ranges at most ``gap`` bytes apart become one request of up to ``longest``
    bytes. A file is dealt in slices of ``longest`` bytes, so a large archive is
    read by many tasks. ``stored_bytes`` is the payload found in the record,
    ``intact`` says that it has the length and digest of its headers.
    """
    schema = RECORD_SCHEMA + (", payload binary" if payloads else "")

    def fetch(wanted: list[dict]) -> Iterator[bytes]:
        at = 0
        while at < len(wanted):
            first, end = wanted[at], wanted[at]["offset"] + wanted[at]["length"]
            stop = at + 1
            while (
                stop < len(wanted)
                and wanted[stop]["file"] == first["file"]
                and wanted[stop]["offset"] - end <= gap
                and wanted[stop]["offset"] + wanted[stop]["length"] - first["offset"] <= longest
            ):
                end = max(end, wanted[stop]["offset"] + wanted[stop]["length"])
                stop += 1
            fs, path = open_fs(first["file"])
            with fs.open_input_file(path) as f:
                block = f.read_at(end - first["offset"], first["offset"])
            for row in wanted[at:stop]:
                a = row["offset"] - first["offset"]
                yield gzip.decompress(block[a : a + row["length"]])
            at = stop

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = re.compile(r"<urn:page:(-?\d+)>")
        for batch in batches:
            rows = []
            for data in fetch(batch.to_pylist()):
                head, body = _parse(data)
                own, to = number.match(head["WARC-Record-ID"]), number.match(head.get("WARC-Refers-To", ""))
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                revisit = head["WARC-Type"] == "revisit"
                intact = revisit or (len(body) == size and hashlib.sha256(body).hexdigest() == digest)
                row = (int(own[1]) if own else None, head["WARC-Target-URI"], head["WARC-Type"], digest, size,
                       int(to[1]) if to else None, len(body), intact)
                rows.append((*row, body) if payloads else row)
            yield _batch(rows, schema)

    part: Column = F.floor(F.col("offset") / longest)
    wanted = index.select("file", "offset", "length", part.alias("_slice"))
    # a number keeps the narrow index from being merged into a few tasks
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartition(tasks, "file", "_slice").sortWithinPartitions("file", "offset").drop("_slice").mapInArrow(read, schema)


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives under ``folder`` and return their index."""
    rows = pick(pages, page_id=page_id, url=url, payload=payload).withColumn("page_id", F.col("page_id").cast("long"))
    return write_archives(mark_revisits(rows), folder)
