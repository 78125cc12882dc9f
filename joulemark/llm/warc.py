"""Web archive records: not-modified revisits get the response that they stand for.

A revisit (the server said 304) is joined, as of its date, to the latest earlier full response under its canonical URL;
the validators that both carry must agree, and the headers that a 304 may change are merged into the response's. An
address may hold any share of all records: an address's records are dealt by time slices, whose last responses are
carried on to the slices after, so no task needs all records of an address.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Time slices, of about as many records each; compressed bytes that are read on at once.
SLICES, CHUNK = 256, 1 << 16
#: Bytes of payloads that a worker returns at once, about.
BYTES = 32_000_000
#: What a 304 may not change in a stored response: figures of the body, and headers of one connection.
KEPT = ("content-length", "content-encoding", "content-type", "content-range", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Parameters that only track where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="

SCHEMA = "record_id string, url string, date timestamp, type string, status int, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default port, fragment, tracking parameters and a final slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z]+://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^(www|m)\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _etag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit in records (SCHEMA): record_id, key, response_id, verdict, headers.

    verdict is `resolved`, `changed` (a validator that both carry differs: entity tag, else last-modified, else payload
    digest; response_id names the response but headers stay the revisit's) or `unresolved` (no earlier response, or no
    date or URL). A response is full with status 200; of equal dates the larger record_id is later, and a response of a
    revisit's own date is not earlier. Header names count in lower case; of names that are then equal the last one
    in the order of their bytes counts (Etag before etag).
    Records of other types are not returned;
    repeated rows are rows of their own; an empty table gives an empty result; extra columns are not read.
    """
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    lower = F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(F.reverse(F.transform(entries, lambda x: x["key"])), e["key"]) == F.size(entries) - i))
    own = records.select("record_id", canonical_url(F.col("url")).alias("key"), "date", (F.col("type") == "response").alias("full"), "status", "type", "digest", lower.alias("headers"))
    own = written(own.where((F.col("full") & (F.col("status") == 200)) | (F.col("type") == "revisit")).select("record_id", "key", "date", "full", "digest", "headers"), "warc-records")
    # slices end at quantiles of all dates, so that one far date, or a busy hour, changes nothing
    steps = [k / SLICES for k in range(1, SLICES)]
    ends = own.agg(F.percentile_approx(F.unix_micros("date"), steps)).first()[0] or []
    slice_ = F.size(F.filter(F.array(*map(F.lit, sorted(set(ends)))), lambda b: b < F.unix_micros("date"))) if ends else F.lit(0)
    known = own.where("key is not null and date is not null").withColumn("slice", slice_)

    # the last response of each slice, and of all slices before it
    last = known.where("full").groupBy("key", "slice").agg(F.max(F.struct("date", "record_id")).alias("last"))
    slices = known.select("key", "slice").distinct().join(last, ["key", "slice"], "left")
    before = F.last("last", True).over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = written(slices.select("key", "slice", before.alias("carried")), "warc-slices")
    # within a slice: the last response of an earlier date
    earlier = Window.partitionBy("key", "slice").orderBy(F.unix_micros("date")).rangeBetween(Window.unboundedPreceding, -1)
    here = F.max(F.when(F.col("full"), F.struct("date", "record_id"))).over(earlier)
    met = known.withColumn("here", here).where(~F.col("full")).join(carried, ["key", "slice"])
    met = met.select("record_id", "key", "digest", "headers", F.coalesce("here", "carried").alias("at"))
    full = known.where("full").select(F.col("key").alias("_key"), F.struct("date", "record_id").alias("_at"), F.col("digest").alias("_digest"), F.col("headers").alias("_headers"))
    full = full.dropDuplicates(["_key", "_at"])
    out = met.join(full, (F.col("key") == F.col("_key")) & (F.col("at") == F.col("_at")), "left")
    unknown = own.where("not full and (key is null or date is null)")
    out = out.unionByName(unknown.select("record_id", "key", "digest", "headers"), allowMissingColumns=True)

    tags, modified = (_etag(F.col("headers")), _etag(F.col("_headers"))), (F.col("headers")["last-modified"], F.col("_headers")["last-modified"])
    both = lambda x: x[0].isNotNull() & x[1].isNotNull()
    digests = (F.col("digest"), F.col("_digest"))
    same = F.when(both(tags), tags[0] == tags[1]).when(both(modified), modified[0] == modified[1]).when(both(digests), digests[0] == digests[1]).otherwise(True)
    verdict = F.when(F.col("_at").isNull(), "unresolved").when(same, "resolved").otherwise("changed")
    new = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT))
    merged = F.map_concat(F.map_filter("_headers", lambda k, v: ~F.map_contains_key(new, k)), new)
    return out.select("record_id", "key", F.col("_at.record_id").alias("response_id"), verdict.alias("verdict"), F.when(verdict == "resolved", merged).otherwise(F.col("headers")).alias("headers"))


def _members(data: bytes) -> Iterator[bytes]:
    """A file's bytes: as they are, or unpacked gzip member by member. A member whose bytes are wrong gives nothing, as any
    of them may be, and what follows is looked for at the next member's first bytes; the last one may end too early."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at, begin, open_, out = memoryview(data), 0, 0, zlib.decompressobj(31), []
    while at < len(data):
        chunk = view[at : at + CHUNK]
        try:
            out.append(open_.decompress(chunk))
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", begin + 1)
            if at < 0:
                return
            begin, open_, out = at, zlib.decompressobj(31), []
            continue
        at += len(chunk)
        if open_.eof:
            at -= len(open_.unused_data)
            yield b"".join(out)
            begin, open_, out = at, zlib.decompressobj(31), []
    yield b"".join(out)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped, as SCHEMA has them, and the payload. A record whose bytes end too early
    is left out; those after it are found. Repeated HTTP headers: the last one counts."""
    rest = b""
    for part in _members(data):
        rest += part
        at = 0
        while (begin := rest.find(b"WARC/1", at)) >= 0:
            end = rest.find(b"\r\n\r\n", begin)
            if end < 0:
                break
            head = dict(line.split(":", 1) for line in rest[begin:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
            head = {k.strip().lower(): v.strip() for k, v in head.items()}
            size = int(n) if (n := head.get("content-length", "0")).isdigit() else 0
            if end + 4 + size > len(rest):
                # it may go on in the next member; another record that begins there means that it does not
                if rest.find(b"\r\nWARC/1", end) < 0:
                    break
                at = end
                continue
            if record := _record(head, rest[end + 4 : end + 4 + size]):
                yield record
            at = begin = end + 4 + size
        rest = rest[at if begin < 0 else begin :] if begin >= 0 else rest[max(at, len(rest) - 6) :]


def _record(head: dict, block: bytes) -> dict | None:
    kind = head.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = http.decode("latin-1").split("\r\n")
    status = lines[0].split(" ")[1] if lines[0].startswith("HTTP/") and " " in lines[0] else ""
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
    return {"record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "type": kind, "status": int(status) if status.isdigit() else None, "headers": headers, "digest": head.get("warc-payload-digest"), "payload": payload}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of the WARC files under path, with their payloads. A file is read as one binary
    value, of 2 GB at most (compressed), and unpacked and returned record by record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for content in x["content"]:
                records, held, size = parse_warc(bytes(content)), [], 0
                for record in itertools.chain(records, [None]):
                    if record is not None:
                        held.append(record)
                        size += len(record["payload"])
                    if held and (record is None or size > BYTES or len(held) >= 1000):
                        out = pd.DataFrame(held)
                        yield out.assign(date=pd.to_datetime(out["date"], utc=True, errors="coerce"))
                        held, size = [], 0

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, SCHEMA + ", payload binary")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records made of pages: each page as a response, and a later visit to its address that was not modified.

    A page is seen at its identifier's second, in an hour's turn again; every seventh revisit carries another entity tag.
    """
    tag = F.md5(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    shown = lambda at: F.from_unixtime(at.cast("long"), "yyyy-MM-dd HH:mm:ss")
    at = F.lit(1_700_000_000) + F.col("page_id") * 2
    response = pages.select(
        F.concat(F.lit("a"), F.col("page_id").cast("string")).alias("record_id"), "url", F.timestamp_seconds(at).alias("date"), F.lit("response").alias("type"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), shown(at)).alias("headers"), tag.alias("digest"),
    )
    again = at + 3601
    wrong = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("x"), tag)).otherwise(F.concat(F.lit("W/"), tag))
    revisit = pages.select(
        F.concat(F.lit("b"), F.col("page_id").cast("string")).alias("record_id"), "url", F.timestamp_seconds(again).alias("date"), F.lit("revisit").alias("type"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), wrong, F.lit("content-type"), F.lit("none"), F.lit("date"), shown(again)).alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return response.unionByName(revisit)
