"""WARC archives: written by tasks, read back by checking chains of record boundaries.

Writing: one record per page; of records with equal payloads of at least 100 bytes the one with the smallest id
is a response and the others are revisits that refer to it. Reading: tasks look for the magic line anywhere in a
block of a file and emit the place of each find with the place its length points at, and follow the chains inside
the block to where they leave it. Pointer jumping from the start of each file (distance doubled per round) over the
places where chains enter blocks keeps those that the file's own chain reaches, so a magic line inside a payload is
rejected however genuine it looks. Then the payloads of true records are read, block by block from its entry on.

Defined results: a null html is an empty payload; a null url is empty; line breaks in a url are percent-encoded;
rows that share the smallest id of their payload are all responses; a null id is never the smallest, and a
payload that only null ids have is a response each time; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import release_since, scratch, scratch_path
from .archives import Reader, Writer
from .common import MOST_TASKS, dealt, materialised

MAGIC = b"WARC/1.1\r\n"
LEAST_SHARED = 100
FILE_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20
TAIL = 1 << 16
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def payloads(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Only payloads that occur twice go into the join; Spark broadcasts them if their written size is small."""
    bare = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    hashed = bare.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    first = materialised(
        hashed.filter(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null").select("digest", "first"), "first-payloads")
    return hashed.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    body = payload if refers_to is None else b""
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {len(payload)}", "Content-Type: text/html"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(body)}")
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def written(rows: DataFrame, folder: str, limit: int = FILE_BYTES) -> DataFrame:
    """Writes the archives; (file, file_bytes) per file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sizes = Writer(folder, ".warc", limit), {}
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*batch.columns):
                name, _ = out.append(record(page_id.as_py(), url.as_py(), payload.as_py().encode(), digest.as_py(), refers_to.as_py()))
                sizes[name] = out.size
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(sizes.keys(), pa.string()), pa.array(sizes.values(), pa.int64())], names=["file", "file_bytes"])
    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "file string, file_bytes bigint")


def header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the header at a place and where its block begins; None if it isn't whole."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    pairs = (line.partition(": ") for line in data[at + len(MAGIC):end].decode("utf-8", "replace").split("\r\n"))
    return {k.lower(): v for k, _, v in pairs}, end + 4


def exits(ats: list[int], nexts: list[int], stop: int) -> list[int | None]:
    """For each find of a block, in order, where its chain comes to a place at or past ``stop``; None if it breaks off before."""
    left: dict[int, int | None] = {}
    for at, ahead in zip(reversed(ats), reversed(nexts)):
        left[at] = ahead if ahead >= stop else left.get(ahead)
    return [left[at] for at in ats]


def candidates(files: DataFrame, folder: str, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, at, next, exit), a row per block with lists of equal length: each magic line with a header and a length, the
    place behind the record it would be, and where its chain leaves the block."""
    starts = files.select("file", "file_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("file_bytes") - 1, F.lit(block).cast("bigint"))).alias("start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name, start, size, found = row["file"], row["start"], row["file_bytes"], []
                stop = min(block, size - start)
                data = reader.read(name, start, stop + TAIL)
                at = data.find(MAGIC)
                while 0 <= at < stop:
                    while (head := header(data, at)) is None and start + len(data) < size:
                        data += reader.read(name, start + len(data), len(data))
                    if head and re.fullmatch("[0-9]{1,18}", head[0].get("content-length", "")):
                        found.append((start + at, start + head[1] + int(head[0]["content-length"]) + 4))
                    at = data.find(MAGIC, at + 1)
                ats, nexts = map(list, zip(*found)) if found else ([], [])
                lists = [pa.array([v], pa.list_(pa.int64())) for v in (ats, nexts, exits(ats, nexts, start + stop))]
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([start // block], pa.int64()), *lists], names=["file", "block", "at", "next", "exit"])
    return dealt(starts).mapInArrow(scan, "file string, block bigint, at array<bigint>, next array<bigint>, exit array<bigint>")


def entries(found: DataFrame) -> DataFrame:
    """(file, entry): where the chain from place 0 of a file enters its blocks; one place per block it has a record in.

    Of the finds only those take part that a chain of another block leads to, about one per block and not one per record. After
    k rounds ``jump`` leads 2^k blocks on and ``reach`` holds the entries nearer than that, so what a round adds is new; it ends when
    nothing is."""
    start = found.select("file").distinct().withColumn("at", F.lit(0).cast("bigint"))
    doors = found.select("file", F.explode(F.array_distinct("exit")).alias("at")).unionByName(start).distinct()
    pairs = found.select("file", F.explode(F.arrays_zip("at", "exit")).alias("pair")).select("file", "pair.at", F.col("pair.exit").alias("next"))
    steps = materialised(pairs.join(doors, ["file", "at"]), "steps")
    jump, reach = steps, start
    while True:
        new = materialised(reach.join(jump.filter("next is not null"), ["file", "at"]).select("file", F.col("next").alias("at")), "reach")
        if new.isEmpty():
            break
        reach = reach.unionByName(new)
        ahead = jump.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        jump = materialised(jump.join(ahead, ["file", "next"]).select("file", "at", F.col("further").alias("next")), "jump")
    # The end of a file and places a broken chain points at are reached too, but no find lies there.
    return steps.join(reach, ["file", "at"], "leftsemi").select("file", F.col("at").alias("entry"))


def reachable(found: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, entry, at, next): the blocks that the chain from place 0 of their file has a record in, with where it enters."""
    true = entries(found).withColumn("block", F.floor(F.col("entry") / block).cast("bigint"))
    return found.drop("exit").join(true, ["file", "block"]).select("file", "block", "entry", "at", "next")


def read_records(blocks: DataFrame, folder: str, tasks: int = MOST_TASKS) -> DataFrame:
    """The records of (file, block, entry, at, next), on the chain from ``entry``, read by ``tasks`` tasks, each from its own blocks;
    fails if a payload doesn't have the digest its header states."""
    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if text in ("None", "") else int(text)

    def parsed(reader: Reader, name: str, at: int, end: int) -> tuple:
        data = reader.read(name, at, end - at)
        fields, begin = header(data, 0)
        body, digest, kind = data[begin:-4], fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
        size = int(fields["payload-length"])
        if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
            raise ValueError(f"{name} at {at}: the payload differs from its digest")
        return number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to", ""))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ahead, at, rows = dict(zip(row["at"], row["next"])), row["entry"], []
                while at in ahead:
                    rows.append(parsed(reader, row["file"], at, ahead[at]))
                    at = ahead[at]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in RESULT.split(", ")])
    # Named, as adaptive execution sees only the few bytes of the places.
    return blocks.repartition(tasks, "file", "block").sortWithinPartitions("file", "block").mapInArrow(read, RESULT)


def round_trip(pages: DataFrame, limit: int = FILE_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """Writes the archives of ``pages`` into the shared folder and reads every record back; the archives go when that is done."""
    mark = len(scratch())
    folder = scratch_path(pages.sparkSession, "warc")
    files = materialised(written(payloads(pages), folder, limit), "warc-files")
    found = materialised(candidates(files, folder, block), "boundaries")
    n_bytes = files.agg(F.coalesce(F.sum("file_bytes"), F.lit(0))).first()[0]
    records = materialised(read_records(reachable(found, block), folder, min(MOST_TASKS, 1 + n_bytes // block)), "warc-records")
    release_since(mark, ("warc-records",))
    return records
