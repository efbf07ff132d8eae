"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME`` bytes; a bundle is a file of frames closed by the public
seekable-format footer (a skippable frame with one entry of compressed and uncompressed size per frame). An index maps each record to its bundle and frame, and to offset
and length inside the frame; with the seek table one record costs one ranged read and the decompression of one frame.

Equal payloads are stored once: the one with the largest id is a ``response`` record, the others are ``revisit`` records
that refer to it. Bundles are written by the tasks that hold the rows, under names of their own for every attempt, and renamed when complete: what a lost or repeated task
leaves is never referred to by the index, which is cut off as a table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, new_path

#: Uncompressed bytes of a frame, and compressed bytes of a bundle, at which the next one begins.
FRAME = 256 << 10
BUNDLE = 64 << 20
LEVEL = 3

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "id long, bundle string, frame int, at long, length long"


def record(kind: str, rid: str, url: str, payload: bytes, digest: bytes, size: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. ``digest`` is the SHA-1 of the full payload; a revisit has no block and says the size in a field of its own."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:pagequery:{rid}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    # A header field is one line; what would break it is percent-encoded.
    clean = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head += [f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"WARC-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:pagequery:{refers_to}>"]
    block = b"" if kind == "revisit" else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record; a broken one is an error."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(head["content-length"])
    if raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("record length and content length differ")
    return head, raw[end + 4 : end + 4 + size]


def footer(sizes: list[tuple[int, int]]) -> bytes:
    """Seek table for frames of the given compressed and uncompressed sizes, without checksums."""
    body = b"".join(struct.pack("<II", c, u) for c, u in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def seek_table(fs, path: str) -> list[tuple[int, int, int, int]]:
    """Per frame of a bundle: compressed start and size, uncompressed start and size; from the footer alone."""
    total = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        n, flags, magic = struct.unpack("<IBI", f.read_at(9, total - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        raw = f.read_at(n * width, total - 9 - n * width)
    out, at, pos = [], 0, 0
    for i in range(n):
        c, u = struct.unpack_from("<II", raw, i * width)
        out.append((at, c, pos, u))
        at, pos = at + c, pos + u
    return out


class _Writer:
    """Writes one task's records into bundles under ``uri`` and yields index rows for each bundle that is complete."""

    def __init__(self, uri: str):
        import zstandard

        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.out = None

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{self.root}/.{self.name}", compression=None)  # the name would have it packed again
        self.at, self.sizes, self.rows, self.frame, self.length = 0, [], [], [], 0

    def add(self, rid: int | None, raw: bytes) -> list[tuple]:
        if self.out is None:
            self._open()
        self.frame.append((rid, raw))
        self.length += len(raw)
        if self.length >= FRAME:
            self._close_frame()
            if self.at >= BUNDLE:
                return self.close()
        return []

    def _close_frame(self) -> None:
        if not self.frame:
            return
        packed = self.zip.compress(b"".join(r for _, r in self.frame))
        pos = 0
        for rid, raw in self.frame:
            self.rows.append((rid, self.name, len(self.sizes), pos, len(raw)))
            pos += len(raw)
        self.sizes.append((len(packed), pos))
        self.out.write(packed)
        self.at += len(packed)
        self.frame, self.length = [], 0

    def close(self) -> list[tuple]:
        """Closes the bundle; its rows."""
        if self.out is None:
            return []
        self._close_frame()
        self.out.write(footer(self.sizes))
        self.out.close()
        self.fs.move(f"{self.root}/.{self.name}", f"{self.root}/{self.name}")
        self.out = None
        return self.rows


_INDEX = pa.schema([("id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("length", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_INDEX)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _INDEX, strict=True)], schema=_INDEX)


def write(pages: DataFrame, uri: str | None = None, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[str, DataFrame]:
    """Write a record for every page; returns the folder of the bundles (in the shared folder if no ``uri`` is given) and the index.

    Of pages with equal payloads of ``least`` bytes or more, the one with the largest id is the response. Null payloads and urls count as empty. Rows that repeat with
    the same id and payload are each written; those with the largest id are all responses. A page with a null id is a response under the name `none` and no copy of any. An empty table makes no bundle. Other columns are ignored.
    """
    spark = pages.sparkSession
    uri = uri or new_path(spark, "warc")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("p"))
    # Copies are found by SHA-256: only ids and hashes are shuffled, folded in the map tasks; few groups have two rows.
    keyed = rows.where(F.col("id").isNotNull() & (F.octet_length("p") >= least)).select("id", F.unhex(F.sha2("p", 256)).alias("h"))
    groups = cut(keyed.groupBy("h").agg(F.max("id").alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "to"), "copies")
    # Where an id repeats with different payloads, the hash says which of its rows is a copy.
    revisits = keyed.join(F.broadcast(groups) if groups.count() <= SEND else groups, "h").where("id <> to").select("id", "h", "to").distinct()
    revisits = cut(revisits, "revisits")
    few = revisits.count() <= SEND
    big = F.when(F.octet_length("p") >= least, F.unhex(F.sha2("p", 256)))
    marked = rows.withColumn("h", big).join(F.broadcast(revisits) if few else revisits, ["id", "h"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(uri)
        for batch in batches:
            for rid, url, text, to in zip(*batch.columns, strict=True):
                rid, to, body = rid.as_py(), to.as_py(), (text.as_py() or "").encode()
                raw = record("response" if to is None else "revisit", "none" if rid is None else str(rid), url.as_py() or "", body, hashlib.sha1(body).digest(), len(body), to)
                if done := writer.add(rid, raw):
                    yield _batch(done)
        yield _batch(writer.close())

    index = cut(marked.select("id", "url", "p", "to").mapInArrow(run, INDEX), "warc-index")
    return uri, index


#: Up to so many revisits (16 bytes each) are sent to all executors; more are joined by a shuffle.
SEND = 1_000_000


def read_records(uri: str, index: DataFrame) -> DataFrame:
    """Read the indexed records back, each frame once: ``id, kind, url, refers_to, payload_bytes, payload_digest`` (hex SHA-1), ``payload`` (null for a revisit).

    The index says in which frame of which bundle a record is, and where there; the frame's own place comes from the bundle's seek table, and everything returned from the
    record: its id is that of WARC-Record-ID (another one than the index says is an error), a response's size and digest are those of its block (other ones in its header are an
    error), and a revisit's those of the response that it refers to (which must be there and agree with its header).
    """
    records = cut(_records(uri, index), "records")
    # Few responses are referred to; a response that very many revisits name is sent to them or, beyond SEND, split by adaptive execution.
    named = records.where("refers_to is not null").groupBy("refers_to").agg(F.count(F.lit(1)).alias("times"))
    named = cut(named.select(F.col("refers_to").alias("to")), "named")
    few = named.count() <= SEND
    full = records.where("kind = 'response'").select(F.col("id").alias("to"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("sha1"))
    full = full.join(F.broadcast(named) if few else named, "to", "left_semi").dropDuplicates(["to", "size", "sha1"])
    full = cut(full, "referred")
    joined = records.join(F.broadcast(full) if few else full, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("sha1")), "left")
    good = F.col("refers_to").isNull() | F.coalesce(F.col("size") == F.col("payload_bytes"), F.lit(False))
    checked = F.when(good, F.coalesce("sha1", "payload_digest")).otherwise(F.raise_error(F.concat(F.lit("revisit and response differ: "), F.col("id").cast("string"))))
    return joined.select("id", "kind", "url", "refers_to", F.coalesce("size", "payload_bytes").alias("payload_bytes"), checked.alias("payload_digest"), "payload")


def _records(uri: str, index: DataFrame) -> DataFrame:
    """Records as they stand in the bundles. Frames are dealt out by bundle and number."""
    frames = index.repartition(F.col("bundle"), F.col("frame")).sortWithinPartitions("bundle", "frame", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = pafs.FileSystem.from_uri(uri)
        unzip = zstandard.ZstdDecompressor()
        at, file, name, frame, table = None, None, None, b"", []
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(part, 256).to_pylist():
                    if name != r["bundle"]:
                        file = fs.open_input_file(f"{root}/{r['bundle']}")
                        table = seek_table(fs, f"{root}/{r['bundle']}")
                        name = r["bundle"]
                    if at != (name, r["frame"]):
                        begin, packed, _, size = table[r["frame"]]
                        frame = unzip.decompress(file.read_at(packed, begin), max_output_size=size)
                        if len(frame) != size:
                            raise ValueError(f"frame {r['frame']} of {name} and the seek table differ")
                        at = (name, r["frame"])
                    found = _parsed(frame[r["at"] : r["at"] + r["length"]])
                    if found[0] != r["id"]:
                        raise ValueError(f"the index has {r['id']} where record {found[0]} is")
                    rows.append(found)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RECORD, strict=True)], schema=_RECORD)

    return frames.mapInArrow(run, "id long, kind string, url string, refers_to long, payload_bytes long, payload_digest string, payload string")


_RECORD = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])


def _number(urn: str) -> int | None:
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name == "none" else int(name)


def _parsed(raw: bytes) -> tuple:
    head, block = parse(raw)
    kind, digest, size = head["warc-type"], base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")), int(head["warc-payload-length"])
    if kind == "response" and (hashlib.sha1(block).digest() != digest or len(block) != size):
        raise ValueError("payload and header differ")
    refers = head.get("warc-refers-to")
    url = head["warc-target-uri"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return _number(head["warc-record-id"]), kind, url, _number(refers) if refers else None, size, digest.hex(), block.decode() if kind == "response" else None
