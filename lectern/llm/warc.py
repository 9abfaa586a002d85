"""WARC archives in seekable Zstandard bundles: written from pages, indexed by record, read back whole or by record."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices, small_side, split_join, staged

#: Payloads of fewer bytes are never revisits; plain bytes of a frame, and stored bytes of a bundle, before the next begins.
LEAST_BYTES, FRAME_BYTES, BUNDLE_BYTES = 1000, 1 << 18, 1 << 26
#: Bundles are read in a task each up to so many tasks, and in several a task beyond.
MOST_TASKS = 20_000
# Fixed values of the seekable format: magic of the skippable frame, and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "bundle string, frame_offset long, frame_bytes long, record_offset long, record_bytes long, record_id string, record_type string, page_id string, refers_to_id string"


def store(uri: str):
    """The file system of a folder that driver and executors share, and the folder's path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# ---- records

def record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes, date: str = DATE) -> bytes:
    """One WARC record; fields without value are left out, and control characters and blanks of values are escaped."""
    clean = lambda v: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), *((k, clean(v) if k.endswith(("URI", "ID")) else v) for k, v in fields if v is not None), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(record_id: str, page_id: str | None, url: str | None, payload: bytes, digest: str, length: int, refers: tuple[str, str | None, str | None] | None) -> bytes:
    """A response with its payload, or a revisit of the record (id, page_id, url) with the response's head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", url), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is None:
        return record("response", record_id, fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers[0]}>"), ("X-Refers-To-Page-ID", refers[1]), ("WARC-Refers-To-Target-URI", refers[2])]
    return record("revisit", record_id, fields, http)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record: {first[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        at = end + 4 + len(block) + 4
        if data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut")
        yield fields, block


def parsed(fields: dict[str, str], block: bytes) -> dict:
    """A page's record as a row; the payload of a response must have the digest and the length that its fields state."""
    head, payload = block.split(b"\r\n\r\n", 1)
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(re.search(rb"(?i)\r\ncontent-length: (\d+)", head)[1])
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload), hashlib.sha1(payload).hexdigest()) != (length, digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    bare = lambda k: fields[k].removeprefix("<urn:uuid:").removesuffix(">") if k in fields else None
    return {"record_id": bare("WARC-Record-ID"), "record_type": fields["WARC-Type"], "page_id": fields.get("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if whole else None, "payload_bytes": length, "payload_digest": digest, "refers_to_id": bare("WARC-Refers-To"), "refers_to": fields.get("X-Refers-To-Page-ID")}


# ---- bundles

class Bundle:
    """A bundle under way: records gather in a frame; each frame is compressed by itself; close() adds the seek table."""

    def __init__(self, files, path: str, level: int = 3):
        import zstandard

        self.out, self.codec = files.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self.name = path.rsplit("/", 1)[1]
        self.frames: list[tuple[int, int]] = []
        self.size, self.plain, self.waiting = 0, bytearray(), []

    def add(self, data: bytes, *about) -> list[tuple]:
        """Index rows of the records of the frame that this one ends, if it does."""
        self.waiting.append((len(self.plain), len(data), *about))
        self.plain += data
        return self.flush() if len(self.plain) >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        if not self.plain:
            return []
        packed = self.codec.compress(bytes(self.plain))
        self.out.write(packed)
        rows = [(self.name, self.size, len(packed), *w) for w in self.waiting]
        self.frames.append((len(packed), len(self.plain)))
        self.size, self.plain, self.waiting = self.size + len(packed), bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """Offset, stored and plain bytes of each frame of an open bundle, from its footer alone."""
    size = file.size()
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("a bundle without seek table")
    file.seek(size - 9 - 8 * n)
    out, at = [], 0
    for stored, plain in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((at, stored, plain))
        at += stored
    return out


def _arrow(rows: list, names: list[str], kinds: str):
    import pyarrow as pa

    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    wanted = [types[k.split()[1]] for k in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), wanted, strict=True)], names)


def _written(folder: str, level: int):
    """Writes records into bundles of the folder and gives their index rows.

    Names are new in each attempt, and a reader takes the bundles that the index names, so that what a lost or repeated
    attempt has left counts for nothing.
    """
    names = [x.split()[0] for x in INDEX.split(", ")]

    def write(batches):
        files, path = store(folder)
        space = uuid.uuid5(uuid.NAMESPACE_URL, folder)
        name = lambda rid: str(uuid.uuid5(space, str(rid)))
        bundle, rows = None, []
        for batch in slices(batches, "html"):
            for rid, page, url, html, digest, n, ref, ref_page, ref_url in zip(*(batch.column(c).to_pylist() for c in ("rid", "page_id", "url", "html", "digest", "n", "ref", "ref_page", "ref_url")), strict=True):
                if bundle is None:
                    bundle = Bundle(files, f"{path}/{uuid.uuid4().hex}.warc.zst", level)
                    own = str(uuid.uuid4())
                    bundle.add(record("warcinfo", own, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), own, "warcinfo", None, None)
                    bundle.flush()
                refers = None if ref is None else (name(ref), ref_page, ref_url)
                made = page_record(name(rid), page, url, html.encode(), digest, n, refers)
                rows += bundle.add(made, name(rid), "revisit" if refers else "response", page, refers and refers[0])
                if bundle.size >= BUNDLE_BYTES:
                    rows, bundle = rows + bundle.close(), None
            if rows:
                yield _arrow(rows, names, INDEX)
                rows = []
        if bundle and (rows := bundle.close()):
            yield _arrow(rows, names, INDEX)

    return write


def write(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into bundles under folder; their staged index (INDEX).

    Of the records whose payloads are equal and have LEAST_BYTES or more, that with the largest page_id (of repeated
    ids, one of the rows) is the response, and the others are revisits of it; all smaller ones are responses.

    A null html is an empty payload; null page_id and url are left out of the record, and a null page_id is the smallest.
    Blanks and control characters in an url are escaped. Repeated rows are records of their own. A very long page is a
    frame of its own. Other columns may have any name, and an empty table writes nothing.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumns({"rid": F.monotonically_increasing_id(), "digest": F.sha1("html"), "hash": F.xxhash64("html"), "n": F.octet_length("html").cast("long")})
    source = staged(source, "warc-pages")
    long = source.filter(F.col("n") >= LEAST_BYTES).select("page_id", "url", "rid", "digest", "hash")
    groups = long.groupBy("digest", "hash").agg(F.count("*").alias("copies"), F.max(F.struct("page_id", "rid", "url")).alias("top")).filter("copies > 1")
    groups = staged(groups.select("digest", "hash", "copies", F.col("top.rid").alias("ref"), F.col("top.page_id").cast("string").alias("ref_page"), F.col("top.url").alias("ref_url")), "warc-groups")
    # At most a thousand payloads can have a thousandth of all pages each.
    many = max(1000, source.count() // 1000)
    again = split_join(long.select("rid", "digest", "hash"), groups, ["digest", "hash"], f"copies > {many}").filter("ref is not null and ref <> rid")
    again = small_side(staged(again.select("rid", "ref", "ref_page", "ref_url"), "warc-revisits"))
    made = source.join(again, "rid", "left").select("rid", F.col("page_id").cast("string").alias("page_id"), "url", F.when(F.col("ref").isNull(), F.col("html")).otherwise("").alias("html"), "digest", "n", "ref", "ref_page", "ref_url")
    files, path = store(folder)
    files.create_dir(path, recursive=True)
    return staged(made.mapInArrow(_written(folder, level), INDEX), "warc-index")


PAGE = "record_id string, record_type string, page_id string, url string, payload binary, payload_bytes long, payload_digest string, refers_to_id string, refers_to string"


def _rows(frames, payload: bool):
    """Arrow batches of page rows from an iterator of plain frames; a batch is closed at about a million bytes."""
    names, rows, size = [x.split()[0] for x in PAGE.split(", ")], [], 0
    for data in frames:
        for fields, block in records(data):
            if fields["WARC-Type"] == "warcinfo":
                continue
            row = parsed(fields, block)
            if not payload:
                row["payload"] = None
            rows.append([row[n] for n in names])
            size += 200 + len(row["payload"] or b"")
            if size >= 1_000_000:
                yield _arrow(rows, names, PAGE)
                rows, size = [], 0
    if rows:
        yield _arrow(rows, names, PAGE)


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """All page records (PAGE) of the bundles that the index names, a bundle a task at least, frame by frame along the seek table."""
    def frames(batches):
        import zstandard

        files, path = store(folder)
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with files.open_input_file(f"{path}/{name}") as file:
                    for at, stored, plain in seek_table(file):
                        file.seek(at)
                        data = codec.decompress(file.read(stored))
                        if len(data) != plain:
                            raise ValueError(f"a frame of {name} has {len(data)} bytes, not {plain}")
                        yield data

    names = index.select("bundle").distinct()
    # Names are few bytes of much work: a stated number of tasks, which Spark does not merge by size.
    return names.repartition(min(max(names.count(), 1), MOST_TASKS)).mapInArrow(lambda batches: _rows(frames(batches), payload), PAGE)


def fetch(index: DataFrame, folder: str, wanted: DataFrame, follow: bool = True) -> DataFrame:
    """asked, and the page record (PAGE) at its place, for each record_id of wanted; with follow, a revisit gives its response.

    Only the frames that hold the records are read, and within them only the records' bytes are parsed.
    """
    places = index.select("record_id", "bundle", "frame_offset", "frame_bytes", "record_offset", "record_bytes")
    asked = wanted.select("record_id").distinct().join(index.select("record_id", "refers_to_id"), "record_id")
    at = F.coalesce("refers_to_id", "record_id") if follow else F.col("record_id")
    asked = asked.select(F.col("record_id").alias("asked"), at.alias("record_id")).join(places, "record_id")

    def one(batches):
        import pyarrow as pa
        import zstandard

        files, path = store(folder)
        codec, last, data = zstandard.ZstdDecompressor(), None, b""
        for batch in batches:
            for x in batch.to_pylist():
                if (x["bundle"], x["frame_offset"]) != last:
                    with files.open_input_file(f"{path}/{x['bundle']}") as file:
                        file.seek(x["frame_offset"])
                        data = codec.decompress(file.read(x["frame_bytes"]))
                    last = x["bundle"], x["frame_offset"]
                for made in _rows([data[x["record_offset"] : x["record_offset"] + x["record_bytes"]]], True):
                    yield pa.RecordBatch.from_arrays([pa.array([x["asked"]]), *made.columns], ["asked", *made.schema.names])

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartition(tasks, "bundle", "frame_offset").sortWithinPartitions("bundle", "frame_offset").mapInArrow(one, f"asked string, {PAGE}")


def archive(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, read back from archives written anew."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    back = read(write(pages, folder), folder, payload=False)
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM q"""
