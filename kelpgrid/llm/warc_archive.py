"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame a record.

Archives are written and read with Spark's own file sources, so that any file system Spark knows
will do and lost tasks are simply written again. A line of the text writer is a run of frames, and a file
holds a set number of lines, parted by an empty skippable frame, which every reader passes over: an archive is
bounded by its bytes, however large the partition is.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.llm.staging import bounded_sample, id_text, new_path, stage, with_long_id

# Magic numbers of the Zstandard frame format and the dictionary frame of .warc.zst.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_LOW, SKIPPABLE_HIGH = 0x184D2A50, 0x184D2A5F
EMPTY_FRAME = struct.pack("<II", SKIPPABLE_LOW, 0)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive that breaks the format: frame, header, length or digest."""


def train_dictionary(samples: list[bytes], size: int = 16_384) -> bytes:
    """A dictionary for records like the samples; the samples' own bytes where there are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _record_id(page_id: int | str | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record_bytes(page_id: int | str | None, url: str | None, payload: bytes, digest: str, refers_to: int | str | None = None) -> bytes:
    """One record: a response, or a revisit without payload if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        headers += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends: its block headers are followed, nothing is decoded."""
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if SKIPPABLE_LOW <= magic <= SKIPPABLE_HIGH:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME_MAGIC:
            end = at + zstandard.frame_header_size(data[at : at + 18])
            last = 0
            while not last:
                head = int.from_bytes(data[end : end + 3].ljust(3, b"\xff"), "little")
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                if kind == 3:
                    raise ArchiveError(f"reserved block in the frame at {at}")
                end += 3 + (1 if kind == 1 else size)
            end += 4 if data[at + 4] & 4 else 0
        else:
            raise ArchiveError(f"no frame at byte {at}")
    except (struct.error, zstandard.ZstdError, IndexError) as error:
        raise ArchiveError(f"broken frame at byte {at}: {error}") from error
    if end > len(data):
        raise ArchiveError(f"the frame at byte {at} is cut off")
    return end


def parse_record(data: bytes) -> dict:
    """Headers, payload and checks of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ArchiveError(f"bad header line {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"{name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"{headers['warc-record-id']}: wrong length")
    block = rest[:-4]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ArchiveError(f"{headers['warc-record-id']}: wrong block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ArchiveError(f"{headers['warc-record-id']}: no HTTP header")
    if headers["warc-type"] == "response":
        said = next((x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
        if not said.isdigit() or int(said) != len(payload) or headers.get("warc-payload-digest") != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise ArchiveError(f"{headers['warc-record-id']}: wrong payload length or digest")
    elif headers["warc-type"] == "revisit" and ("warc-refers-to" not in headers or payload):
        raise ArchiveError(f"{headers['warc-record-id']}: a revisit refers to a record and has no payload")
    return headers | {"payload": payload}


def records(data: bytes) -> Iterator[dict]:
    """The records of one archive, each decoded from its own frame with the leading dictionary."""
    if not data:
        return
    if data[:4] != struct.pack("<I", DICTIONARY_MAGIC):
        raise ArchiveError("the archive does not start with a dictionary frame")
    at = frame_end(data, 0)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:at]))
    while at < len(data):
        end = frame_end(data, at)
        if data[at : at + 4] == struct.pack("<I", FRAME_MAGIC):
            try:
                yield parse_record(decoder.decompress(data[at:end]))
            except zstandard.ZstdError as error:
                raise ArchiveError(f"frame at byte {at}: {error}") from error
        at = end


def _id_of(record_id: str | None) -> str | None:
    said = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return None if said in ("", "null") else said


def write_archives(pages: DataFrame, path: str, level: int = 3, sample_rows: int = 512, line_bytes: int = 1 << 20, lines: int = 64) -> None:
    """Writes ``page_id, url, html, payload_digest, refers_to`` as archives below ``path``.

    An archive ends with the line that fills it: ``lines`` of ``line_bytes`` or little more, or of one record that is larger.
    The dictionary is trained on a sample bounded by ``sample_rows`` (least hashes of the page_id).
    """
    sample = bounded_sample(pages.select("page_id", F.substring("html", 1, 8192).alias("html")), "page_id", sample_rows).collect()
    dictionary = train_dictionary(sorted((r.html or "").encode() for r in sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
        done, held, size = 0, [], 0
        for rows in batches:
            for i, u, h, d, r in zip(rows.page_id, rows.url, rows.html, rows.payload_digest, rows.refers_to):
                if not held and done % lines == 0:  # the first line of a file
                    held.append(dictionary_frame(dictionary))
                held.append(coder.compress(record_bytes(i, u, (h or "").encode("utf-8", "surrogatepass"), d, r)))
                size += len(held[-1])
                if size >= line_bytes:
                    yield pd.DataFrame({"frames": [b"".join(held)]})
                    done, held, size = done + 1, [], 0
        if held:
            yield pd.DataFrame({"frames": [b"".join(held)]})

    picked = pages.select(id_text("page_id").alias("page_id"), "url", "html", "payload_digest", id_text("refers_to").alias("refers_to"))
    frames = picked.mapInPandas(run, "frames binary").select(F.col("frames").cast("string").alias("value"))
    frames.write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", lines).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``.

    A revisit has the digest of the payload it refers to and no payload of its own. Frames, headers, lengths
    and digests are validated; a broken archive raises :class:`ArchiveError`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for data in files.content:
                held, size = [], 0
                for r in records(bytes(data)):
                    own = r["warc-type"] == "response"
                    n = str(len(r["payload"])) if own else None
                    held.append((_id_of(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], _id_of(r.get("warc-refers-to")), n, r["warc-payload-digest"].removeprefix("sha256:"), r["payload"] if own and payloads else None))
                    size += len(r["payload"])
                    if len(held) >= 512 or size > 1 << 25:
                        yield _frame(held)
                        held, size = [], 0
                yield _frame(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = files.mapInPandas(run, "page_id string, url string, record_type string, refers_to string, payload_bytes string, payload_digest string, payload binary")
    return with_long_id(found, "page_id", "refers_to", "payload_bytes")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"], dtype=object)


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``page_id, url, html, payload_digest, refers_to``; refers_to is set for all but the first of equal payloads.

    A null html is empty. Of equal payloads of at least ``least_bytes`` the rows of the smallest
    page_id are responses and the others refer to it. Rows without a page_id are responses.
    """
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).alias("bytes"))
    firsts = picked.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = picked.join(firsts.select("payload_digest", "first"), "payload_digest", "left")
    return joined.select("page_id", "url", "html", "payload_digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes every page as a record, reads the archives back and describes each record.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``: the length of a revisit is
    that of the response of the same payload that it refers to; several responses may have one page_id. Repeated rows and
    repeated ids give a record each; an empty table gives none.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(with_revisits(pages, least_bytes), path)
    found = stage(read_archives(spark, path, payloads=False).drop("url", "payload"), "records")
    own = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("referred")).distinct()
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes").join(own, ["refers_to", "payload_digest"], "left")
    revisits = revisits.withColumn("payload_bytes", F.when(F.col("referred").isNotNull(), F.col("referred")).otherwise(F.raise_error(F.lit("a revisit refers to another payload")).cast("long")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.where("record_type = 'response'").select(columns).unionByName(revisits.select(columns))
