"""Operator 3: WARC archives in Zstandard form, written and read back.

An archive starts with a skippable frame that holds the compression
dictionary, trained on a bounded sample of the archive's own first records;
after it each record is one frame. Tasks write archives of bounded size to
the shared folder under names of their own, and return a manifest; only what
the manifest lists counts, so files of failed attempts do no harm. The reader
loads the dictionary from the leading frame, decodes frame by frame, and
raises ValueError when a header, a length or a digest isn't right.

Of records with equal payloads (equal SHA-1) of at least least_bytes bytes,
the one with the largest page_id is the response and the others are revisits
of it, stored without their payload; all smaller ones are responses. Which
payloads repeat is found on digests alone; pages whose payload surely doesn't
are written where they are read, and only the others are shuffled, salted, so
that one very common page is spread over tasks.

Defined cases: a null html is an empty payload; a null url is replaced by the
page's own name; a null page_id counts as smaller than any other, and is read
back as null; rows that repeat the response's page_id and payload are
responses too; very long payloads are records of their own archive, up to
LARGEST_RECORD, above which reading raises ValueError; columns other than
page_id, url and html are never read; empty tables write no archive and give
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeflow.llm import arrow, sieve
from scribeflow.runtime import cut_lineage, fresh_path

#: Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
MANDATORY = ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Raw bytes after which a task starts another archive, and those that the dictionary is trained on.
ROLL = 48_000_000
SAMPLE = 4_000_000
DICTIONARY = 32_768
LARGEST_RECORD = 1 << 31
#: Parts among which the rows of one payload are dealt.
SALTS = 16


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of one WARC/1.1 record: headers, block, closing line ends."""
    digest = base32_sha1(payload)
    name = lambda i: f"<urn:page:{'' if i is None else i}:{digest}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name(page_id)[1:-1]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_for(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on the records, or, with too few, their first bytes; None without any."""
    if not records:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY, records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(r[:1024] for r in records[:8]), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The pieces of an archive of records."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE:
            break
        sample.append(r[:65_536])
        size += len(sample[-1])
    own = dictionary_for(sample)
    data = own.as_bytes() if own else b""
    yield struct.pack("<II", SKIPPABLE_MAGIC, len(data)) + data
    squeeze = zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=True) if own else zstandard.ZstdCompressor(level=3, write_checksum=True)
    for r in records:
        yield squeeze.compress(r)


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame (plain, or itself compressed) and where the records start."""
    if len(data) < 8:
        raise ValueError("an archive starts with a skippable frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC or 8 + size > len(data):
        raise ValueError("an archive starts with a whole skippable frame that holds the dictionary")
    own = bytes(data[8 : 8 + size])
    if own.startswith(ZSTD_MAGIC):
        own = zstandard.ZstdDecompressor().decompress(own, max_output_size=1 << 24)
    if not own:
        return None, 8 + size
    kind = zstandard.DICT_TYPE_FULLDICT if own.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(own, dict_type=kind), 8 + size


def frames(data: memoryview) -> Iterator[bytes]:
    """The content of each frame after the dictionary."""
    own, at = load_dictionary(data)
    expand = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()
    while at < len(data):
        one, parts, size = expand.decompressobj(), [], 0
        while not one.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut off")
            piece = data[at : at + 65_536]
            parts.append(one.decompress(piece))
            size += len(parts[-1])
            if size > LARGEST_RECORD:
                raise ValueError("a record is larger than the limit")
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def parse(content: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of a record; ValueError if it isn't sound."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        fields[key.strip().lower()] = value.strip()
    for key in MANDATORY:
        if key.lower() not in fields:
            raise ValueError(f"{key} is missing")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length isn't that of the block")
    block = rest[:-4]
    if fields.get("warc-block-digest") not in (None, f"sha1:{base32_sha1(block)}"):
        raise ValueError("the block has another digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind not in ("response", "revisit") or not gap or not size:
        raise ValueError("not an HTTP response or revisit")
    if kind == "response" and (int(size[1]) != len(payload) or base32_sha1(payload) != digest):
        raise ValueError("the payload has another length or digest")
    if kind == "revisit" and payload:
        raise ValueError("a revisit has no payload")
    page = lambda key: (lambda m: int(m[1]) if m and m[1] else None)(re.fullmatch(r"<urn:page:(-?\d*):[A-Z2-7]+>", fields.get(key, "")))
    return {"page_id": page("warc-record-id"), "payload_bytes": int(size[1]), "payload_digest": digest, "record_type": kind, "refers_to": page("warc-refers-to") if kind == "revisit" else None, "payload": payload}


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the manifest: path, records, bytes."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    again = own.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    again = cut_lineage(again.where("n > 1 AND first IS NOT NULL").select("sha", "first"))
    some, single = sieve.parted(own, F.xxhash64("sha"), again.select(F.xxhash64("sha").alias("k")))
    salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = some.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = some.select("page_id", "url", "html", refers.alias("refers_to")).unionByName(single.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))
    kind, out = arrow.schema(None, "path string, records long, bytes long")

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def flush(held: list[bytes]) -> pa.RecordBatch:
            path, size = f"{base}/{uuid.uuid4().hex}.warc.zst", 0
            with store.open_output_stream(path, compression=None) as f:
                for piece in archive(held):
                    f.write(piece)
                    size += len(piece)
            return arrow.batch(out, [path], [len(held)], [size])

        held, size = [], 0
        for b in batches:
            for page, url, html, response in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page, url, html.encode("utf-8", "surrogatepass"), "response" if response is None else "revisit", response, date))
                size += len(held[-1])
                if size >= ROLL:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return cut_lineage(rows.mapInArrow(run, kind))


def read_archives(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """A row for each record of the archives in the manifest; with its payload if asked for."""
    kind, out = arrow.schema(None, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload)

    @arrow.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    data = memoryview(f.read())  # an archive is of bounded size
                seen, rows = 0, []
                for content in frames(data):
                    got = parse(content)
                    rows.append([got[c.name] for c in out])
                    seen += 1
                    if len(rows) >= 2000:
                        yield arrow.batch(out, *map(list, zip(*rows, strict=True)))
                        rows = []
                if seen != records:
                    raise ValueError(f"{path} has {seen} records, its manifest {records}")
                if rows:
                    yield arrow.batch(out, *map(list, zip(*rows, strict=True)))

    archives = manifest.count()
    parts = max(archives // 8, min(archives, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)  # at most about 8 archives a task
    return manifest.select("path", "records").repartition(parts).mapInArrow(run, kind)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives of pages in the shared folder, read back: a row for each record."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes), folder)
