"""WARC files as a Python data source, for reading and writing.

``spark.read.format("warc").load(path)`` reads a file or a folder of ``.warc`` and ``.warc.gz`` files, whoever wrote them. One input
partition is a stretch of about ``split_bytes`` of a file: plain files are cut at record borders, compressed ones at gzip members (a file
that is one member is one partition's work). Filters on ``record_type`` and on the named header columns are taken over by the reader: a
record's header is parsed first, and the block of one that the filters reject is passed over; so is every block if the schema
asked for has no ``payload`` column. Where the writer left an index, what is passed over is neither read nor inflated;
elsewhere it has to be inflated to find its end, but is not kept. Files are read in blocks of ``READ`` bytes.

``df.write.format("warc").save(dir)`` writes WARC 1.1, a gzip member for each record and a warcinfo record first. Each task writes
one archive and one index under names of its own; the commit lists the finished ones in ``_MANIFEST``, and a folder with that list is read
by it, so what failed or repeated tasks leave behind is never read. The folder must be one that driver and executors
share (any URI that pyarrow.fs knows). A response or revisit is written as an HTTP message, of which the payload is the body; the
payload of any other record is its block. Blocks that announce themselves as HTTP are read that way too (encodings
of the transfer are left as they are).

Defined results: payloads keep any bytes; a null payload is an empty one. Header names in any case, folded lines, and values that are no UTF-8 (with
replacement characters) are read. A missing header is null. A truncated last record is left out. Empty files and folders have no rows.
Spark hands filters to Python sources only if spark.sql.python.filterPushdown.enabled is set (off by default); without it
they are applied after reading. ``register`` sets it.
"""

from __future__ import annotations

import datetime
import json
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import Scratch, fresh, join_heads, table

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, warc_date string, content_type string, payload_digest string, payload_length long, payload binary"
#: Column -> WARC header; payload_length is an extension header that gives the length of the full payload, of revisits too.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "warc_date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
#: Columns whose values stand in angle brackets.
BRACKETED = ("record_id", "refers_to")
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL, READ = 1, 4 << 20
_HTTP = "application/http; msgtype=response"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _clean(value) -> str:
    """A header value on one line, percent-encoded where it would break the header."""
    return "".join(c if c not in "\r\n%" else f"%{ord(c):02X}" for c in str(value))


def _plain(value: str) -> str:
    for code, c in (("%0D", "\r"), ("%0A", "\n"), ("%25", "%")):
        value = value.replace(code, c)
    return value


def encode(row: dict, now: str) -> bytes:
    """A record, without compression; the block ends with the two line breaks that end a record."""
    block = row.get("payload") or b""
    row = {"record_id": f"urn:uuid:{uuid.uuid4()}", "record_type": "resource", "warc_date": now} | {k: v for k, v in row.items() if v is not None}
    kind = row["record_type"]
    if kind in ("response", "revisit"):
        row["content_type"] = _HTTP
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + block
    lines = ["WARC/1.1"]
    for c, h in HEADERS.items():
        if c in row:
            lines.append(f"{h}: <{_clean(row[c])}>" if c in BRACKETED else f"{h}: {_clean(row[c])}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {_REVISIT_PROFILE}")
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_header(raw: bytes) -> dict:
    """Lower-case names and values of a header; of a repeated name the first value, and the version line under ''."""
    out, last = {}, None
    for k, line in enumerate(raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")):
        if k == 0:
            out[""] = line
        elif line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        else:
            name, colon, value = line.partition(":")
            last = name.strip().lower() if colon else None
            if last in out:
                last = None
            elif last:
                out[last] = value.strip()
    return out


def columns_of(header: dict) -> dict:
    values = {c: header.get(h.lower()) for c, h in HEADERS.items()}
    values = {c: v if v is None else _plain(v.removeprefix("<").removesuffix(">") if c in BRACKETED else v) for c, v in values.items()}
    if values["payload_length"] is not None:
        values["payload_length"] = int(values["payload_length"]) if values["payload_length"].isdigit() else None
    return values


class Window:
    """A file, read in blocks."""

    def __init__(self, f):
        self.f, self.size, self.start, self.data = f, f.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from a place on; fewer at the end."""
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.f.seek(min(at, self.size))
            self.start, self.data = at, self.f.read(max(n, READ))
        return self.data[at - self.start : at - self.start + n]


class Flow:
    """The bytes of one gzip member, or of a plain file, from a place on; nothing is inflated before it is asked for."""

    def __init__(self, window: Window, at: int, packed: bool):
        self.window, self.at, self.out = window, at, bytearray()
        self.z = zlib.decompressobj(31) if packed else None

    def more(self) -> bool:
        if self.z is None:
            new = self.window.get(self.at, 1 << 16)
            self.at += len(new)
        else:
            if self.z.eof:
                return False
            fed = self.z.unconsumed_tail
            if not fed:
                fed = self.window.get(self.at, 1 << 16)
                self.at += len(fed)
            if not fed:
                return False
            new = self.z.decompress(fed, 1 << 18)
            if self.z.eof:
                self.at -= len(self.z.unused_data)
            elif not new and not self.z.unconsumed_tail:
                return self.more()
        self.out += new
        return bool(new)

    def header(self) -> bytes | None:
        """Up to the blank line that ends a header; None where no further header is. Line breaks before it are passed over."""
        while True:
            lead = len(self.out) - len(self.out.lstrip(b"\r\n"))
            del self.out[:lead]
            ends = [(k, n) for k, n in ((self.out.find(b"\r\n\r\n"), 4), (self.out.find(b"\n\n"), 2)) if k >= 0]
            if ends:
                k, n = min(ends)
                found = bytes(self.out[:k])
                del self.out[: k + n]
                return found
            if not self.more():
                return None

    def place(self) -> int:
        """Where in a plain file the next byte is."""
        return self.at - len(self.out)

    def block(self, n: int, keep: bool) -> bytes | None:
        """The next n bytes (None if there are fewer), or b'' after passing over them."""
        if not keep and self.z is None and n > len(self.out):
            self.at += n - len(self.out)
            self.out.clear()
            return b"" if self.at <= self.window.size else None
        while keep and len(self.out) < n:
            if not self.more():
                return None
        while not keep and n > len(self.out):
            n -= len(self.out)
            self.out.clear()
            if not self.more():
                return None
        found = bytes(self.out[:n]) if keep else b""
        del self.out[:n]
        return found


def is_record(raw: bytes | None) -> bool:
    return raw is not None and raw[:5] == b"WARC/" and parse_header(raw).get("content-length", "").isdigit()


def first_border(window: Window, begin: int, end: int, packed: bool) -> int | None:
    """The first place in [begin, end) at which a record (a member that opens with one) begins; a payload may hold what looks like one,
    so after a plain record the next one or the end must follow, and a member must open with a whole record header."""
    mark = b"\x1f\x8b\x08" if packed else b"WARC/"
    at = begin
    while at < end:
        data = window.get(at, READ)
        k = data.find(mark)
        if k < 0:
            if len(data) <= len(mark):
                return None
            at += len(data) - len(mark) + 1
            continue
        at += k
        if at >= end:
            return None
        try:
            flow = Flow(window, at, packed)
            raw = flow.header()
            if is_record(raw):
                if packed:
                    return at
                before = window.get(max(0, at - 2), min(2, at))
                if at == 0 or before.endswith(b"\n"):
                    flow.block(int(parse_header(raw)["content-length"]), False)
                    rest = window.get(flow.place(), 64).lstrip(b"\r\n")
                    if not rest or rest[:5] == b"WARC/":
                        return at
        except zlib.error:
            pass
        at += 1
    return None


def records(window: Window, begin: int, end: int, packed: bool, wants):
    """(header, block or None) of the records that begin in [begin, end). wants(header): None to pass over the record, else
    whether its block is wanted."""
    at = first_border(window, begin, end, packed)
    while at is not None and at < end:
        flow = Flow(window, at, packed)
        while packed or flow.place() < end:
            raw = flow.header()
            if not is_record(raw):
                break
            header = parse_header(raw)
            want = wants(header)
            block = flow.block(int(header["content-length"]), bool(want))
            if block is None:
                break
            if want is not None:
                yield header, block if want else None
        if not packed:
            return
        while flow.more():  # what is left of the member
            flow.out.clear()
        at = flow.at if flow.z.eof and flow.at < window.size else None


def indexed(window: Window, index, wants):
    """As records, for members that begin where the index says; what is not wanted is not read."""
    for k in range(len(index) - 1):
        flow = Flow(window, index[k], True)
        header = parse_header(flow.header() or b"")
        want = wants(header)
        if want is not None:
            yield header, flow.block(int(header["content-length"]), True) if want else None


def payload_of(header: dict, block: bytes) -> bytes:
    """The block, or the body of the HTTP message that it is."""
    if header.get("content-type", "").lower().startswith("application/http"):
        ends = [k for k in (block.find(b"\r\n\r\n") + 4, block.find(b"\n\n") + 2) if k >= 4]
        return block[min(ends) :] if ends else b""
    return block


class Stretch(InputPartition):
    def __init__(self, path: str, begin: int, end: int, by_index: bool):
        super().__init__(path)
        self.path, self.begin, self.end, self.by_index = path, begin, end, by_index


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.root = options["path"].rstrip("/")
        self.split = int(options.get("split_bytes", 16 << 20))
        self.wanted: list[tuple[str, set | None]] = []

    def pushFilters(self, filters):
        """Takes over equality, IN and NOT NULL on the columns that are headers; hands back the rest."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADERS and column != "payload_length" and isinstance(f, EqualTo | In | IsNotNull):
                self.wanted.append((column, None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.root)
        out = []
        if fs.get_file_info(f"{root}/_MANIFEST").is_file:
            with fs.open_input_stream(f"{root}/_MANIFEST") as f:
                names = json.loads(f.read())["archives"]
            for name, size, n in names:  # only counts and sizes reach the driver; tasks read their part of an archive's index
                parts = max(1, min(n, -(-size // self.split)))
                out += [Stretch(f"{root}/{name}", n * k // parts, n * (k + 1) // parts, True) for k in range(parts)]
        else:
            info = fs.get_file_info(root)
            files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
            for x in sorted((x for x in files if x.is_file and x.path.endswith((".warc", ".warc.gz"))), key=lambda x: x.path):
                out += [Stretch(x.path, at, min(at + self.split, x.size), False) for at in range(0, x.size, self.split)]
        return out or [Stretch("", 0, 0, False)]

    def wants(self, header: dict) -> bool | None:
        values = columns_of(header)
        if any(values[c] is None or (w is not None and values[c] not in w) for c, w in self.wanted):
            return None
        return "payload" in self.columns

    def read(self, partition):
        fs, _ = pafs.FileSystem.from_uri(self.root)
        if partition.begin == partition.end:
            return
        types = dict(x.split(" ") for x in SCHEMA.split(", "))
        kinds = pa.schema([(c, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[types[c]]) for c in self.columns])
        rows, held = [], 0
        with fs.open_input_file(partition.path) as f:
            window = Window(f)
            if partition.by_index:
                with fs.open_input_file(f"{partition.path}.idx") as g:
                    g.seek(8 * partition.begin)
                    index = memoryview(g.read(8 * (partition.end - partition.begin + 1))).cast("q")
                found = indexed(window, index, self.wants)
            else:
                found = records(window, partition.begin, partition.end, partition.path.endswith(".gz"), self.wants)
            for header, block in found:
                values = columns_of(header)
                if block is not None:
                    values["payload"] = payload_of(header, block)
                    held += len(values["payload"])
                rows.append([values[c] for c in self.columns])
                if len(rows) >= 4000 or held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), kinds, strict=True)], schema=kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), kinds, strict=True)], schema=kinds)


class Written(WriterCommitMessage):
    def __init__(self, name: str, size: int, n: int):
        self.name, self.size, self.n = name, size, n


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, batches):
        fs, root = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(root, recursive=True)
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        name, n = f"{uuid.uuid4().hex}.warc.gz", 0
        # the index: where each record's member begins, and the archive's end; it is written as records are
        with fs.open_output_stream(f"{root}/{name}", compression=None) as f, fs.open_output_stream(f"{root}/{name}.idx") as index:
            info = _member(encode({"record_type": "warcinfo", "content_type": "application/warc-fields", "payload": b"software: proseline\r\nformat: WARC File Format 1.1\r\n"}, now))
            f.write(info)
            at = len(info)
            for batch in batches:
                for row in batch.to_pylist():
                    record = _member(encode(row, now))
                    index.write(at.to_bytes(8, "little"))
                    f.write(record)
                    at, n = at + len(record), n + 1
            index.write(at.to_bytes(8, "little"))
        return Written(name, at, n)

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(root, recursive=True)
        old = []
        if not self.overwrite and fs.get_file_info(f"{root}/_MANIFEST").is_file:
            with fs.open_input_stream(f"{root}/_MANIFEST") as f:
                old = json.loads(f.read())["archives"]
        with fs.open_output_stream(f"{root}/_MANIFEST") as f:
            f.write(json.dumps({"archives": old + [[m.name, m.size, m.n] for m in messages if m is not None and m.n]}).encode())

    def abort(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.root)
        for m in messages:
            if m is not None:
                for name in (m.name, f"{m.name}.idx"):
                    fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


_PUSH = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Makes the source known, and switches on the handing of filters to Python sources, which the session may still set otherwise: it
    has no other effect, and without it every header predicate would be checked after reading."""
    spark.dataSource.register(WarcSource)
    if spark.conf.get(_PUSH, "false") == "false" and not spark.sparkContext.getConf().contains(_PUSH):
        spark.conf.set(_PUSH, "true")


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """columns: those wanted; without payload, payloads are skipped."""
    register(spark)
    types = dict(x.split(" ") for x in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {types[c]}" for c in columns or types)).load(path)


def write_warc(df: DataFrame, path: str) -> None:
    """df: the columns of SCHEMA, in any order; missing ones are null, others are left out."""
    register(df.sparkSession)
    types = dict(x.split(" ") for x in SCHEMA.split(", "))
    df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]).write.format("warc").mode("append").save(path)


def find_revisits(pages: DataFrame, *, least: int = 100, id_col: str = "page_id", payload_col: str = "payload", scratch: Scratch | None = None) -> DataFrame:
    """(id, digest, refers_to) of the pages that revisit another: of equal payloads of at least ``least`` bytes all but the one with the smallest id.

    Only ids and digests travel. Digests that hold a large share of the rows are few, whatever the table's size, and are joined by
    broadcast, so a hot payload is in no task of its own. Where ids repeat with one payload all rows of the smallest id are responses, and with several
    payloads each is judged by itself; rows with a null id are responses.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    digest = F.sha2(payload_col, 256).alias("digest")
    rows = scratch.save(pages.where((F.octet_length(payload_col) >= least) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), digest))
    heads = rows.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1")
    return join_heads(rows, scratch.save(heads), "digest", rows.count()).where("id <> refers_to").select("id", "digest", "refers_to").distinct()


def mark_revisits(pages: DataFrame, *, least: int = 100, id_col: str = "page_id", payload_col: str = "payload", scratch: Scratch | None = None) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to; columns of these names are replaced.

    Pages whose id and digest are not in a bitmap of the revisits' (at most 8 MB) are responses and stay where they are; only the others,
    revisits but for a few, are joined."""
    added = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in added])
    scratch = scratch or Scratch(pages.sparkSession)
    revisits = scratch.save(find_revisits(pages, least=least, id_col=id_col, payload_col=payload_col, scratch=scratch))
    key = lambda i, d: F.xxhash64(F.col(i).cast("string"), d)
    sized = F.octet_length(payload_col).cast("long")
    marked = pages.select("*", sized.alias("payload_bytes"), F.sha2(payload_col, 256).alias("payload_digest"))
    near = fresh(marked, "revisit_near")
    marked = is_likely(marked, revisits.select(key("id", F.col("digest")).alias("key")), F.when(sized >= least, key(id_col, F.col("payload_digest"))), near)
    again = revisits.select(F.col("id").alias(f"{near}_id"), F.col("digest").alias(f"{near}_digest"), "refers_to")
    joined = marked.where(near).join(again, (F.col(id_col) == F.col(f"{near}_id")) & (F.col("payload_digest") == F.col(f"{near}_digest")), "left")
    kinds = [F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to"]
    kept = [*[F.col(f"`{c}`") for c in pages.columns], "payload_bytes", "payload_digest"]
    alone = marked.where(~F.col(near)).withColumn("refers_to", F.lit(None).cast(pages.schema[id_col].dataType))
    return joined.select(*kept, *kinds).unionByName(alone.select(*kept, *kinds))


def is_likely(rows: DataFrame, keys: DataFrame, key: Column, name: str, bits: int = 1 << 26) -> DataFrame:
    """rows with a column that tells whether the key is set in a bitmap of all keys (64-bit hashes): true for all that are among them and for
    some others. The bitmap has ``bits`` bits in pieces of 32768, at most 8 MB, whatever the number of keys. A null key is not set."""
    spot = lambda k: F.pmod(k, F.lit(bits))
    pieces = keys.select(spot(F.col("key")).alias("s")).groupBy(F.floor(F.col("s") / 32768).alias("piece")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits"))
    own = rows.withColumn(f"{name}_spot", spot(key))
    at = F.col(f"{name}_spot") % 32768
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = own.join(F.broadcast(pieces.withColumnsRenamed({"piece": f"{name}_piece"})), F.floor(F.col(f"{name}_spot") / 32768) == F.col(f"{name}_piece"), "left")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(name))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages to archives in the shared folder and answers from the archives alone.

    Responses are read with their payloads, whose digest and length are computed anew; revisits by their headers only. Like every use of the
    source it switches on the handing of filters to Python sources for the session (see ``register``).
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    scratch = Scratch(spark)
    marked = mark_revisits(pages, scratch=scratch)
    path = scratch.path()
    records = marked.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        "record_type",
        F.col("url").alias("target_uri"),
        F.concat(F.lit("urn:page:"), F.col("refers_to").cast("string")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        F.col("payload_bytes").alias("payload_length"),
        F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"),
    )
    write_warc(records, path)
    page = lambda c: F.expr(f"CAST(nullif(substring({c}, 10), '') AS BIGINT)")
    responses = read_warc(spark, path, ["record_id", "record_type", "payload"]).where("record_type = 'response'")
    responses = responses.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_warc(spark, path, ["record_id", "record_type", "refers_to", "payload_digest", "payload_length"]).where("record_type = 'revisit'")
    revisits = revisits.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.expr("substring(payload_digest, 8)").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)
