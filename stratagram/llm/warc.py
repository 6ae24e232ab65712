"""WARC archives: writer, monolithic gzip normaliser, indexed reader.

Archives often come as one gzip stream over the whole file, which can be read
from the start only.  ``normalise`` inflates such a stream once, in bounded
memory, finds the records by their Content-Length, rewrites each as a gzip
member of its own and writes a sidecar index of member offsets beside the
file.  ``read_records`` then reads members by index, any number of tasks to a
file.

Payloads are stored once: of records with equal payloads of ``REVISIT_BYTES``
or more, the one of the largest page_id (of those, the largest url) is a
response and the others revisit it.  Null html counts as empty, null url as an
empty target.  A null page_id is kept as null and counts as smallest.  Repeated
rows: one of them is the response, the others revisit its page_id.  Very long
pages are records like others, held one at a time.  An empty table gives no
files.  Other columns are ignored.

Files appear under their names only when whole, so a task may run again.  A
stream that ends before its last member does, or with other records than were
written, is an error; nothing is deleted then.  Zero bytes after a member are
padding.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkFolder, documents_only, shuffle_parts, table

REVISIT_BYTES = 1000
#: Bytes of an archive whose records are read by one task.
READ_BYTES = 64 << 20
#: Records that such a task holds at a time.
READ_AT_ONCE = 256
_CHUNK = 1 << 18
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# ---------------------------------------------------------------------- records


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _field(value: str | None) -> str:
    """Header values are one line: control characters, blanks and % are percent-encoded."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def make_record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False, name: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP head and leaves out the payload.  ``name`` tells records apart; the response that others revisit goes by its digest."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(name or digest)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_field(url)}", f"X-Page-Id: {'' if page_id is None else page_id}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(digest)}", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC head, HTTP head, payload), names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda b: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in b.decode("utf-8", "replace").split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def split_stream(chunks):
    """Whole records of an inflated WARC stream, given in pieces of any size."""
    buffer = bytearray()
    need = None
    for chunk in chunks:
        buffer += chunk
        while True:
            if need is None:
                at = buffer.find(b"\r\n\r\n")
                if at < 0:
                    break
                found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", bytes(buffer[:at]))
                if not found:
                    raise ValueError("a record without Content-Length")
                need = at + 4 + int(found[1]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer.strip():
        raise ValueError("the stream ends inside a record")


def inflate(stream):
    """Pieces of a gzip stream of any number of members, zero bytes between them or not."""
    d, open_ = zlib.decompressobj(31), False
    while raw := stream.read(_CHUNK):
        while raw:
            if not open_:
                raw = raw.lstrip(b"\0")
                if not raw:
                    break
                open_ = True
            if out := d.decompress(raw, _CHUNK):
                yield out
            raw = d.unconsumed_tail
            if d.eof:
                raw, d, open_ = d.unused_data, zlib.decompressobj(31), False
    # What is still held back when the input ends inside a member.
    while open_ and (out := d.decompress(d.unconsumed_tail, _CHUNK)):
        yield out
        open_ = not d.eof
    if open_:
        raise ValueError("the stream ends inside a gzip member")


# ------------------------------------------------------------------------ files


def _fs(path: str):
    # Spark's names of object stores, in pyarrow's words.
    path = re.sub(r"^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/*", "file:///", path) if path.startswith("file:") else "file://" + path)


class _Whole:
    """A file that gets its name when it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = _fs(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.part, compression=None)
        return self.out

    def __exit__(self, failed, *_):
        self.out.close()
        if failed:
            self.fs.delete_file(self.part)
        else:
            if not isinstance(self.fs, pafs.LocalFileSystem) and self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
                self.fs.delete_file(self.path)
            self.fs.move(self.part, self.path)


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Records (page_id, url, html, digest, revisit, refers_to, held) as one gzip stream per partition; (file, records)."""

    def run(batches):
        from pyspark import TaskContext

        rows = ((batch, i) for batch in batches for i in range(batch.num_rows))
        first = next(rows, None)
        if first is None:
            return
        part, n = TaskContext.get().partitionId(), 0
        path = f"{folder}/pages-{part:06d}.warc.gz"
        with _Whole(path) as out:
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            for batch in (x for head in ([first[0]], batches) for x in head):
                for i in range(batch.num_rows):
                    page_id, url, html, digest, revisit, refers_to, held = (c[i].as_py() for c in batch.columns)
                    name = None if held and not revisit else f"record {part} {n} {folder}"
                    out.write(z.compress(make_record(page_id, url, html or b"", digest, refers_to, revisit, name)))
                    n += 1
            out.write(z.flush())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["file", "records"])

    rows = records.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "revisit", "refers_to", "held")
    return rows.mapInArrow(run, "file string, records long")


def _rewrite(fs, source: str, target: str, level: int, records: int | None) -> list[tuple]:
    """One file, member by member, and its sidecar; its index."""
    offset, index = 0, []
    with _Whole(target) as out, fs.open_input_stream(source, compression=None) as stream:
        for raw in split_stream(inflate(stream)):
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            out.write(member)
            found = re.search(rb"(?im)^warc-record-id:[ \t]*(\S+)", raw[: raw.find(b"\r\n\r\n")])
            index.append((target, offset, len(member), found[1].decode() if found else None))
            offset += len(member)
        if records is not None and len(index) != records:
            raise ValueError(f"{source}: {len(index)} records of {records}")
    with _Whole(target + ".idx") as out:
        out.write("".join(f"{o} {n} {r or '-'}\n" for _, o, n, r in index).encode())
    return index


def _sidecar(target: str) -> list[tuple]:
    fs, path = _fs(target + ".idx")
    with fs.open_input_stream(path, compression=None) as stream:
        lines = stream.read().decode().splitlines()
    return [(target, int(o), int(n), None if r == "-" else r) for o, n, r in (x.split(" ") for x in lines)]


def normalise(files: DataFrame, folder: str, level: int = 6, consume: bool = False) -> DataFrame:
    """Rewrite each file member by member below ``folder``; the index: (file, offset, length, record_id).

    The same index is written beside each file as ``<file>.idx``, a line per
    record.  Where ``files`` has a column records, a file must hold as many.
    ``consume`` deletes a source when its copy and index are whole; a task that
    runs again finds the copy and takes its index.
    """
    counted = "records" in files.columns

    def run(batches):
        for batch in batches:
            for source, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = _fs(source)
                target = f"{folder}/{source.rsplit('/', 1)[-1]}"
                if consume and fs.get_file_info(at).type == pafs.FileType.NotFound:
                    index = _sidecar(target)
                else:
                    index = _rewrite(fs, at, target, level, records)
                    if consume:
                        fs.delete_file(at)
                for i in range(0, len(index), 5000):
                    c = list(zip(*index[i : i + 5000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string())], names=["file", "offset", "length", "record_id"])

    rows = files.select("file", F.col("records").cast("long") if counted else F.lit(None).cast("long").alias("records"))
    return rows.mapInArrow(run, "file string, offset long, length long, record_id string")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar index of every file below ``folder``."""
    lines = spark.read.text(f"{folder}/*.idx").select("value", F.regexp_replace(F.input_file_name(), r"\.idx$", "").alias("file"))
    parts = F.split("value", " ")
    return lines.select("file", parts[0].cast("long").alias("offset"), parts[1].cast("long").alias("length"), F.nullif(parts[2], F.lit("-")).alias("record_id"))


def _row(raw: bytes) -> tuple:
    """One record as a row; its payload must match its digest."""
    warc, http, payload = parse_record(raw)
    revisit = warc["warc-type"] == "revisit"
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("the payload doesn't match its digest")
    number = lambda k: int(warc[k]) if warc.get(k) else None
    url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), warc["warc-target-uri"])
    return number("x-page-id"), url, warc["warc-type"], int(http["content-length"]) if revisit else len(payload), digest, number("x-refers-to-page-id"), payload


_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records read by their index, with size and digest of the full payload (and the payload)."""

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: 6 + with_payload]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]

    def run(batches):
        opened, stream = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, READ_AT_ONCE):
                out = []
                for file, offset, length in zip(*[c.to_pylist() for c in batch.slice(at, READ_AT_ONCE).columns]):
                    if file != opened:
                        if stream:
                            stream.close()
                        fs, path = _fs(file)
                        opened, stream = file, fs.open_input_file(path)
                    try:
                        out.append(_row(zlib.decompress(stream.read_at(length, offset), 31))[: 6 + with_payload])
                    except ValueError as e:
                        raise ValueError(f"{file} at {offset}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if stream:
            stream.close()

    dealt = index.select("file", "offset", "length").repartition(shuffle_parts(index.sparkSession), F.col("file"), F.floor(F.col("offset") / READ_BYTES))
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, _READ + ", payload binary" * with_payload)


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, revisit, refers_to, held): who holds a payload, alone or not, and who refers to it."""
    rows = documents_only(pages, "page_id", "url", "html")
    rows = rows.withColumn("html", F.coalesce("html", F.lit("")).cast("binary")).withColumn("digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest", "page_id", "url").agg(F.count("*").alias("twins"))
    who = F.struct(F.coalesce(F.col("page_id"), F.lit(-(2**63)).cast("long")).alias("order"), F.col("page_id").isNotNull().alias("known"), "url", "page_id", "twins")
    holders = large.groupBy("digest").agg(F.max(who).alias("holder"), F.sum("twins").alias("n")).where("n > 1")
    holders = holders.select(F.col("digest").alias("same"), "holder")
    joined = rows.join(holders, (rows["digest"] == holders["same"]) & (F.octet_length(rows["html"]) >= REVISIT_BYTES), "left")
    holds = F.col("page_id").eqNullSafe(F.col("holder.page_id")) & F.col("url").eqNullSafe(F.col("holder.url"))
    held = F.col("holder").isNotNull()
    marked = joined.select("page_id", "url", "html", "digest", (held & ~holds).alias("revisit"), F.when(held & ~holds, F.col("holder.page_id")).alias("refers_to"), held.alias("held"), (held & holds & (F.col("holder.twins") > 1)).alias("twin"))
    # Rows that equal their holder: one is the response.  They are the same, so their number is all that's needed.
    twins = large.join(holders.where("holder.twins > 1"), (F.col("digest") == F.col("same")) & F.col("page_id").eqNullSafe(F.col("holder.page_id")) & F.col("url").eqNullSafe(F.col("holder.url")), "left_semi")
    if not twins.limit(1).count():  # pages move a second time only where rows repeat
        return marked.drop("twin")
    one = rows.join(twins.select(F.col("digest").alias("same"), F.col("page_id").alias("own"), F.col("url").alias("at"), "twins"), (F.col("digest") == F.col("same")) & F.col("page_id").eqNullSafe(F.col("own")) & F.col("url").eqNullSafe(F.col("at")))
    one = one.groupBy("digest", "page_id", "url", "twins").agg(F.first("html").alias("html"))
    copies = one.select("page_id", "url", "html", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "twins")).alias("k")).repartition("digest", "k")
    copies = copies.select("page_id", "url", "html", "digest", (F.col("k") > 1).alias("revisit"), F.when(F.col("k") > 1, F.col("page_id")).alias("refers_to"), F.lit(True).alias("held"))
    return marked.where(~F.col("twin")).drop("twin").unionByName(copies)


def archive_pages(pages: DataFrame, folder: WorkFolder) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as indexed archives below ``folder``; the index, stored."""
    files = folder.materialise(write_monolithic(with_revisits(pages), f"{folder}/whole"), "files")
    # A file to a task: names are short, and a stream can only be read from its start.
    index = folder.materialise(normalise(files.repartition(shuffle_parts(pages.sparkSession)), f"{folder}/members", consume=True), "index")
    folder.remove("whole")
    return index


def op8_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages"), WorkFolder(spark, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages),
held AS (SELECT digest, max(page_id) AS holder FROM rows WHERE bytes >= {REVISIT_BYTES} GROUP BY digest)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, r.digest AS payload_digest,
  CASE WHEN h.holder IS NULL OR h.holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.holder <> page_id THEN h.holder END AS refers_to
FROM rows r LEFT JOIN held h ON r.digest = h.digest AND r.bytes >= {REVISIT_BYTES}
"""
