"""Operator 7: WARC archives of pages, with revisits, segments and chunked transfers.

Writing: one record per page. Of pages with equal payloads of ``REVISIT_FROM`` bytes or more, that with the
smallest id is a response; the others are revisits of it and carry only their HTTP
head. A record's identifier is made of its page's id and its payload's digest, so a revisit names the very record it refers to. Payloads over ``CHUNKED_FROM`` bytes are sent in chunked transfer framing; a
block over ``SEGMENT_CHARS`` is cut into a first record and continuation records. Records are
rows of Spark's text sink, parted by the two line ends the format wants, so files
come about by the same commit as any table's: a lost executor's task is written
again, and nothing depends on a local folder.

Reading: files are inflated and parsed by content length as a stream, a few records at a time. Continuation records are grouped by the
identifier of their origin and ordered by segment number; numbers must be gapless and
lengths must sum to the stated total. The chunked framing is decoded, and the payload
compared with its digest. Anything else raises: an archive that cannot be put
together is an error, not a missing row.

Cases: a null page is an empty payload; null urls are left out of the record; of rows
with equal ids and payloads one counts as the page, the others are revisits of it (responses, if they are small); a null id comes
after all others; an empty table writes no record; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared import table, table_path, written

REVISIT_FROM, CHUNKED_FROM, CHUNK_CHARS, SEGMENT_CHARS = 100, 4_096, 2_000, 16_384
HEAVY_SHARE, FILE_ROWS = 1_000, 4_000
#: Names and numbers of the archive format.
VERSION, CRLF, BETWEEN = "WARC/1.1", "\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def firsts(pages: DataFrame, least_bytes: int = REVISIT_FROM) -> DataFrame:
    """(page_id, digest, refers_to) of all revisits. ``pages`` has (page_id, bytes, digest).

    Digests are counted before anything is joined. Those with over a thousandth of all
    rows are fewer than a thousand: they are broadcast, so that no task gets all copies
    of one; the rest is joined by digest.
    """
    large = pages.filter(F.col("bytes") >= least_bytes)
    groups = written(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "warc-groups")
    bound = max(100, pages.count() // HEAVY_SHARE)
    heavy, light = groups.filter(F.col("n") > bound), groups.filter(F.col("n") <= bound)
    many = large.join(F.broadcast(heavy), "digest")
    few = large.join(F.broadcast(heavy), "digest", "left_anti").join(light, "digest")
    return many.unionByName(few).filter("not page_id <=> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()


def numbered(rows: DataFrame, small: DataFrame) -> DataFrame:
    """``rows`` with ``again``, which tells rows with equal ids and digests apart: 0 for one of each, then 1, 2 ...; ``small`` has the ids
    and digests of all. Repeated rows are counted before they are numbered, so no task gets all of them one by one; those that
    come again with ``REVISIT_FROM`` bytes or more no longer need their payload."""
    repeated = written(small.groupBy("page_id", "digest").count().filter("count > 1").select("page_id", "digest"), "warc-repeated")
    if repeated.isEmpty():
        return rows.withColumn("again", F.lit(0).cast("long"))
    same = rows["page_id"].eqNullSafe(repeated["page_id"]) & (rows["digest"] == repeated["digest"])
    once = rows.join(repeated, same, "left_anti").withColumn("again", F.lit(0).cast("long"))
    counts = rows.join(repeated, same, "left_semi").groupBy("page_id", "digest", "url", "bytes").agg(F.count("*").alias("n"), F.max("html").alias("html"))
    before = F.sum("n").over(Window.partitionBy("page_id", "digest").orderBy("url").rowsBetween(Window.unboundedPreceding, -1))
    each = counts.withColumn("_from", F.coalesce(before, F.lit(0))).withColumn("again", F.explode(F.sequence("_from", F.col("_from") + F.col("n") - 1)))
    html = F.when((F.col("again") == 0) | (F.col("bytes") < REVISIT_FROM), F.col("html")).otherwise("")
    return once.unionByName(each.select("page_id", "url", html.alias("html"), "bytes", "digest", "again"))


def _http(body: str, n_bytes: int, chunked: bool) -> str:
    head = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
    if not chunked:
        return f"{head}Content-Length: {n_bytes}{BETWEEN}{body}"
    parts = [body[i : i + CHUNK_CHARS] for i in range(0, len(body), CHUNK_CHARS)]
    framed = "".join([f"{len(x.encode()):x}{CRLF}{x}{CRLF}" for x in parts])
    return f"{head}Transfer-Encoding: chunked{BETWEEN}{framed}0{BETWEEN}"


def _record(headers: list[tuple[str, object]], block: str) -> str:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block.encode())}"]
    return CRLF.join(lines) + BETWEEN + block


def record_id(page_id: int | None, digest: str, *more: object) -> str:
    return f"<urn:page:{':'.join(map(str, ['' if page_id is None else page_id, digest, *more]))}>"


def records(page_id: int | None, url: str | None, html: str, n: int, digest: str, refers_to: int | None, again: int) -> Iterator[str]:
    """The records of one page with a payload of ``n`` bytes; ``again`` counts earlier rows with the same id and payload."""
    number = (again,) if again else ()
    name = record_id(page_id, digest, *number)
    target = record_id(page_id if refers_to is None else refers_to, digest)
    revisits = refers_to is not None or again > 0 and n >= REVISIT_FROM
    head = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if revisits:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", target)]
        yield _record(head, _http("", n, False))
        return
    block = _http(html, n, n >= CHUNKED_FROM)
    parts = [block[i : i + SEGMENT_CHARS] for i in range(0, len(block), SEGMENT_CHARS)]
    if len(parts) == 1:
        yield _record(head, block)
        return
    yield _record([*head, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, digest, again, k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k)]
        if k == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block.encode())))
        yield _record(more, part)


def write(pages: DataFrame, path: str) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``. The pages are shuffled once, by id."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    base = base.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    small = written(base.select("page_id", "bytes", "digest"), "warc-digests")
    rows, revisits = numbered(base, small), firsts(small)
    # A null id has its own key, or it would find nothing.
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rows = rows.withColumn("_key", key).join(revisits.select(key.alias("_key"), "digest", "refers_to"), ["_key", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out = []
                for r in batch.slice(lo, 500).to_pylist():
                    out += records(r["page_id"], r["url"], r["html"], r["bytes"], r["digest"], r["refers_to"], r["again"])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows.select("page_id", "url", "html", "bytes", "digest", "refers_to", "again").mapInArrow(run, "value string").write.options(lineSep=BETWEEN, compression="gzip", maxRecordsPerFile=FILE_ROWS).text(path)


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a file in parts: as it is, or out of its gzip members."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            part = member.decompress(data, step)
            data = member.unconsumed_tail
            if not part and not member.eof:
                raise ValueError("an archive ends within a gzip member")
            yield part
        data = member.unused_data


def parse(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive that comes in parts: named fields in lower case, and the block."""
    held, parts, more = b"", iter(parts), True
    while more or held:
        head = held.find(b"\r\n\r\n")
        if head >= 0:
            version, *lines = held[:head].decode("utf-8").split(CRLF)
            if not version.startswith("WARC/"):
                raise ValueError(f"not the beginning of a record: {version[:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            end = head + 4 + int(fields["content-length"])
            while more and len(held) < end + 4:
                taken = [held]
                while more and sum(map(len, taken)) < end + 4:
                    part = next(parts, None)
                    more = part is not None
                    taken.append(part or b"")
                held = b"".join(taken)
            if held[end : end + 4] != b"\r\n\r\n":
                raise ValueError("a record is shorter or longer than it says")
            yield fields, held[head + 4 : end]
            held = held[end + 4 :]
        elif more:
            part = next(parts, None)
            more = part is not None
            held += part or b""
        else:
            raise ValueError("an archive ends within a record's head")


def dechunked(body: bytes) -> bytes:
    """The payload within chunked transfer framing."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked body ends early")
        n = int(body[at:line].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + n])
        if len(out[-1]) != n or body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("a chunk is shorter or longer than it says")
        at = line + 4 + n


def payload(block: bytes) -> tuple[bytes, int]:
    """Payload of an HTTP block, and the length its head states (-1: none)."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split(CRLF)[1:])}
    if fields.get("transfer-encoding", "").lower() == "chunked":
        body = dechunked(body)
        return body, len(body)
    return body, int(fields.get("content-length", -1))


def assembled(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a segmented record from (number, total length, block) in any order."""
    parts = sorted(parts)
    if [n for n, _, _ in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments are missing or twice there")
    whole = b"".join([x for _, _, x in parts])
    if parts[-1][1] is None or parts[-1][1] != len(whole):
        raise ValueError("segments do not sum to their total length")
    return whole


SEGMENT = "struct<number:int,total:long,block:binary>"
HEAD = "page_id long, record_type string, payload_digest string, refers_to long"


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every page."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("path").rlike(r"\.(gz|txt|warc)$")).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                out: list[dict] = []
                for fields, block in parse(inflated(raw.as_py())):
                    continued = fields["warc-type"] == "continuation"
                    number = int(fields.get("warc-segment-number", 0))
                    name = fields["warc-segment-origin-id" if continued else "warc-record-id"]
                    total = fields.get("warc-segment-total-length")
                    refers, page = (x.strip("<>").split(":")[2] if x else "" for x in (fields.get("warc-refers-to"), name))
                    out.append(
                        {
                            "origin": name,
                            "page_id": int(page) if page else None,
                            "record_type": None if continued else fields["warc-type"],
                            "payload_digest": None if continued else fields["warc-payload-digest"].partition(":")[2],
                            "refers_to": int(refers) if refers else None,
                            "segment": {"number": number, "total": int(total) if total else None, "block": block},
                        }
                    )
                    if len(out) >= 500:
                        yield pa.RecordBatch.from_pylist(out, PARTS)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, PARTS)

    parts = files.mapInArrow(split, f"origin string, {HEAD}, segment {SEGMENT}")
    # Most records are whole: only segmented ones are shuffled, a page's segments to one row.
    whole = parts.filter("segment.number = 0").select("page_id", "record_type", "payload_digest", "refers_to", F.array("segment").alias("segments"))
    cut = parts.filter("segment.number > 0").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("record_type").alias("record_type"), F.max("payload_digest").alias("payload_digest"), F.max("refers_to").alias("refers_to"), F.collect_list("segment").alias("segments")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out: list[dict] = []
                for r in batch.slice(lo, 200).to_pylist():
                    got = [(x["number"], x["total"], x["block"]) for x in r.pop("segments")]
                    block = got[0][2] if len(got) == 1 and not got[0][0] else assembled(got)
                    body, n = payload(block)
                    if r["record_type"] == "response":
                        if hashlib.sha256(body).hexdigest() != r["payload_digest"] or n not in (-1, len(body)):
                            raise ValueError(f"payload of page {r['page_id']} is not what its record says")
                        n = len(body)
                    r["payload_bytes"] = n
                    out.append(r | {"payload": body if r["record_type"] == "response" else None} if with_payload else r)
                yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] * with_payload)]))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    columns = ["page_id", "record_type", "payload_digest", "refers_to", "segments"]
    return whole.select(columns).mapInArrow(join, schema).unionByName(cut.select(columns).mapInArrow(join, schema))


PARTS = pa.schema(
    [
        ("origin", pa.string()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("segment", pa.struct([("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])),
    ]
)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)
