"""WARC archives: written by tasks, read back in byte ranges.

Every record is a gzip member of its own, so an archive can be read from any
member on. A reading task takes a byte range, looks for the gzip magic from its
first byte on, takes a candidate for a member only if its head decodes to a WARC
version line and what follows its end is another such member or the end of the file, and
owns the records that start inside its range, to their ends.

Archives are on shared storage and are reached with pyarrow file systems. Each
task names its file anew, and the table of files that its successful attempts
return says which of them count, so a task that ran twice harms nothing.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import TEXT_BATCH, batches
from threadloom.operators.joins import sized_join
from threadloom.sources.tables import materialize, scratch_path

RANGE = 8 << 20
# Payloads of at least so many bytes are not stored twice.
LEAST = 0
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
# Bytes read at a time, and handed to the unpacker at a time.
_READ = 256 << 10
_STEP = 8 << 10
# Ranges that a task reads, where there are many more than slots.
_TASK_RANGES = 16
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def storage(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path inside it, from a URI or a local path."""
    if ":/" not in path:
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as tasks can open it: without a scheme, Spark takes it on the default file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.removeprefix("-").isdigit() else None


def _one_line(text: str) -> str:
    """Header values cannot hold line ends; percent signs mark them."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _lines(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with one record; ``refers_to`` makes it a revisit without payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    revisit = refers_to is not None
    block = head.encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page)),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    if revisit:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", _PROFILE)]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def fields_of(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of an unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


class MemberReader:
    """Members of a gzip file that start inside a byte range."""

    def __init__(self, source: pa.NativeFile, start: int, stop: int):
        self.source, self.start, self.stop = source, start, stop
        self.size = source.size()
        # What was read last, and where it lies in the file.
        self.buffer, self.base = b"", 0

    def _at(self, offset: int, n: int) -> bytes:
        """Bytes of the file from the buffer, which moves on when they go past its end."""
        n = min(n, self.size - offset)
        if n <= 0:
            return b""
        if offset < self.base or offset + n > self.base + len(self.buffer):
            kept = self.buffer[offset - self.base :] if self.base <= offset < self.base + len(self.buffer) else b""
            more = min(max(n - len(kept), _READ), self.size - offset - len(kept))
            self.buffer, self.base = kept + self.source.read_at(more, offset + len(kept)), offset
        return self.buffer[offset - self.base : offset - self.base + n]

    def _begins(self, offset: int) -> bool:
        """A member with a WARC version line begins here."""
        head = self._at(offset, 4_096)
        if not head.startswith(_MAGIC):
            return False
        try:
            return zlib.decompressobj(31).decompress(head, len(_VERSION)).startswith(_VERSION)
        except zlib.error:
            return False

    def member(self, offset: int) -> tuple[bytes, int] | None:
        """Unpacked content of the member and the offset of its end; None if it is broken."""
        unpacker, parts, at = zlib.decompressobj(31), [], offset
        while not unpacker.eof:
            raw = self._at(at, _STEP)
            if not raw:
                return None
            try:
                parts.append(unpacker.decompress(raw))
            except zlib.error:
                return None
            at += len(raw)
        return b"".join(parts), at - len(unpacker.unused_data)

    def _next(self, offset: int) -> int | None:
        """First offset from here on, inside the range, where a candidate begins."""
        while offset < self.stop:
            raw = self._at(offset, _READ + len(_MAGIC) - 1)
            spot = raw.find(_MAGIC)
            while spot >= 0 and offset + spot < self.stop:
                if self._begins(offset + spot):
                    return offset + spot
                spot = raw.find(_MAGIC, spot + 1)
            offset += _READ
        return None

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at, sure = self.start, self.start == 0
        while at < self.stop:
            if not (sure and self._begins(at)):
                found = self._next(at)
                if found is None:
                    return
                at, sure = found, False
            whole = self.member(at)
            # Inside a stored payload a member may stand too, but not a chain of them.
            if whole is None or not (sure or whole[1] == self.size or self._begins(whole[1])):
                at, sure = at + 1, False
                continue
            yield at, whole[0]
            at, sure = whole[1], True


# --- Spark ----------------------------------------------------------------------


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", source: str = "html", least: int = LEAST
) -> DataFrame:
    """Write a record per row below ``folder``; gives the files: path, bytes, records.

    Of equal payloads of at least ``least`` bytes those with the largest id are
    responses, the others revisit it. Only payloads that repeat are joined back: broadcast if they are
    few, by salted key if not.
    """
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{source}`").cast("binary"), F.lit(b"")).alias("payload"),
    )
    digested = rows.select("page_id", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").alias("size"))
    repeated = (
        digested.where(F.col("size") >= least)
        .groupBy(F.col("sha1").alias("of"))
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("of", "first")
    )
    named = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    marked = sized_join(named, repeated, "sha1", "of", "left", F.col("page_id")).select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    )

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = storage(folder)
        sink, path, n = None, f"{base}/pages-{uuid.uuid4().hex}.warc.gz", 0
        for frame in frames:
            for page, url, payload, first in zip(*(frame[c] for c in ("page_id", "url", "payload", "first")), strict=True):
                if sink is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
                sink.write(record(page.as_py(), url.as_py(), payload.as_py(), first.as_py()))
                n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [fs.get_file_info(path).size], "records": [n]})

    schema = "path string, bytes long, records long"
    with batches(pages.sparkSession, TEXT_BATCH):
        return materialize(marked.mapInArrow(write, schema), "warc-files")


def read_archives(spark: SparkSession, files: DataFrame, folder: str, size: int = RANGE) -> DataFrame:
    """Records of the archives: page_id, url, payload (NULL in a revisit), payload_bytes,
    payload_digest, record_type, refers_to. Ranges of ``size`` bytes are dealt to tasks,
    a few ranges each: a given number of partitions is not merged by adaptive execution."""
    ranges = files.select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size))).alias("start")
    )
    count = ranges.count()
    tasks = max(min(count, 4 * spark.sparkContext.defaultParallelism), -(-count // _TASK_RANGES), 1)
    dealt = ranges.repartition(tasks)

    def records(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = storage(folder)
        for frame in frames:
            for path, start in zip(frame["path"].to_pylist(), frame["start"].to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    held, weight = [], 0
                    for _, raw in MemberReader(source, start, start + size):
                        fields, block = fields_of(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
                        url = fields.get("warc-target-uri")
                        revisit = fields["warc-type"] == "revisit"
                        held.append(
                            (
                                _page(fields["warc-record-id"]),
                                None if url is None else _lines(url),
                                None if revisit else payload,
                                int(length.partition(b":")[2]),
                                fields["warc-payload-digest"].removeprefix("sha1:"),
                                fields["warc-type"],
                                _page(fields.get("warc-refers-to")),
                            )
                        )
                        weight += len(raw)
                        if len(held) >= 256 or weight > 16 << 20:
                            yield _batch(held)
                            held, weight = [], 0
                    if held:
                        yield _batch(held)

    return dealt.mapInArrow(records, _FIELDS)


_FIELDS = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long"
)
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split() for f in _FIELDS.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, names, strict=True)], [name for name, _ in names]
    )


def round_trip(pages: DataFrame, least: int = LEAST, size: int = RANGE) -> DataFrame:
    """Write archives to the shared folder and read them back.

    A NULL or empty page has an empty payload. Rows with the largest id are responses all, should
    an id repeat; a NULL id is never the largest and its record has no number. Empty
    tables give no archive and no rows.
    """
    spark = pages.sparkSession
    folder = qualified(spark, scratch_path(spark, "warc"))
    return read_archives(spark, write_archives(pages, folder, least=least), folder, size)
