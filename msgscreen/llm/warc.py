"""Operator 1: a deterministic sharded writer of WARC archives, and a reader.

Records are dealt into ranges of the page id that hold about equal payload
bytes: ranges that hold too much are cut again, and a single id that does (or the
null ids) is cut by digest, so neither outlying nor repeated ids fill one shard
(only rows that agree in both stay together). Their number depends on the bytes
alone. A range is written by one task in order of id, digest and url; a file is
rolled once its compressed size reaches ``file_bytes``, so no task holds more
than a record. Headers, record ids and digests are made anew from the rows, and
each record is a gzip member of its own. A file is written under a temporary
name, unlike any other attempt's, and then renamed; the names, sizes and digests
of finished files form the manifest, a table that Spark commits last. Readers go
by the manifest alone, so files of lost or repeated attempts never count, and
the same rows give the same bytes again, however they are read or partitioned.
What lost attempts left under temporary names is removed after the commit.

Of records with equal payloads of at least ``revisit_bytes`` bytes, that with
the largest page id is a response and the others revisit it (profile: identical
payload digest, no payload of their own).

Defined cases: null html is an empty payload; a null url writes no target; a
null id goes to the first range, is never another record's response unless all
of its group have none, and is read back as null; rows that repeat the
response's id are responses too; an empty table gives an empty manifest; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgscreen.llm.common import scratch, small_batches, stash

FILE_BYTES = 64 << 20
SHARD_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges of ids whose bytes the driver gathers to cut shards, in each round.
BINS = 1 << 14
#: A range is cut again while it holds more than this part of a shard.
FINENESS = 4
#: Bytes that a record counts beside its payload.
HEADER_BYTES = 1024
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_page_id long, last_page_id long"
RECORDS = ("record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, "
           "refers_to long, file string")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}:{repeat}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, repeat: int, date: str) -> bytes:
    """One record, compressed."""
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, repeat)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        lines += [] if refers_to is None else [f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    lines += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Roller:
    """Writes records to files of one shard; yields a manifest row as each file is finished."""

    def __init__(self, root: str, shard: int, file_bytes: int):
        self.fs, self.root = filesystems.FileSystem.from_uri(root)
        self.shard, self.file_bytes, self.number, self.out = shard, file_bytes, 0, None

    def add(self, record: bytes, page_id: int | None) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.fs.create_dir(self.root, recursive=True)
            self.out, self.size, self.records, self.sum, self.first = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256(), page_id
        self.out.write(record)
        self.sum.update(record)
        self.size, self.records, self.last = self.size + len(record), self.records + 1, page_id
        if self.size >= self.file_bytes:
            yield self.finish()

    def finish(self) -> tuple:
        self.out.close()
        final = f"{self.root}/{self.name}"
        if self.fs.get_file_info(final).type != filesystems.FileType.NotFound and self.fs.type_name != "local":
            self.fs.delete_file(final)  # an earlier attempt's, with the same bytes
        self.fs.move(self.temporary, final)
        self.out, self.number = None, self.number + 1
        return self.name, self.shard, self.records, self.size, self.sum.hexdigest(), self.first, self.last

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            yield self.finish()


def revisits(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages that revisit another; ``pages`` has page_id, sha1, payload_bytes."""
    groups = (pages.where(F.col("payload_bytes") >= revisit_bytes).groupBy("sha1", "payload_bytes")
              .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("sha1", "payload_bytes", "refers_to"))
    hits = pages.join(groups, ["sha1", "payload_bytes"]).where("NOT page_id <=> refers_to")
    return hits.select("page_id", "sha1", "refers_to").distinct()


class Ranges:
    """Ranges of (id, digest) in ascending order, null ids first, and the shard of each.

    ``edges``: the first id of each range of ids; ``parts``: into how many ranges of digests each is cut."""

    def __init__(self, edges: np.ndarray, parts: np.ndarray, shards: np.ndarray | None = None):
        self.edges, self.parts, self.shards = edges, parts, shards
        self.base = np.concatenate([[0], np.cumsum(parts)])

    def number(self, page_id: pd.Series, sha1: pd.Series) -> np.ndarray:
        """Each row's range; the null ids' ranges come first."""
        null = page_id.isna().to_numpy()
        at = np.zeros(len(page_id), dtype=np.int64)
        at[~null] = np.searchsorted(self.edges, page_id[~null].astype("Int64").to_numpy(dtype=np.int64), side="right")
        out = self.base[at]
        for i in np.flatnonzero(self.parts[at] > 1).tolist():
            out[i] += int(sha1.iat[i][:15], 16) * int(self.parts[at[i]]) >> 60
        return out

    def numbers(self):
        @F.pandas_udf("long")
        def number(page_id: pd.Series, sha1: pd.Series) -> pd.Series:
            return pd.Series(self.number(page_id.astype("string").map(int, na_action="ignore"), sha1))

        return lambda page_id, sha1: number(F.col(page_id).cast("string"), F.col(sha1))

    def shard_number(self):
        @F.pandas_udf("int")
        def shard(page_id: pd.Series, sha1: pd.Series) -> pd.Series:
            return pd.Series(self.shards[self.number(page_id.astype("string").map(int, na_action="ignore"), sha1)].astype(np.int32))

        return lambda page_id, sha1: shard(F.col(page_id).cast("string"), F.col(sha1))

    @classmethod
    def of(cls, keys: DataFrame, shards: int) -> Ranges:
        """Ranges of ``keys`` (page_id, sha1, payload_bytes) for so many shards. Each round gathers a row per range."""
        lowest, highest = keys.agg(F.min("page_id"), F.max("page_id")).first()
        edges, ends = ([lowest], [highest]) if lowest is not None else ([], [])
        parts = [1] * (len(edges) + 1)
        while True:
            ranges = cls(np.array(edges, dtype=np.int64), np.array(parts, dtype=np.int64))
            sizes = np.zeros(int(ranges.base[-1]), dtype=np.int64)
            weight = F.sum(F.col("payload_bytes") + HEADER_BYTES).alias("n")
            for b, n in keys.groupBy(ranges.numbers()("page_id", "sha1").alias("b")).agg(weight).collect():
                sizes[b] = n
            most = int(sizes.sum()) // (FINENESS * shards) + 1
            whole = np.add.reduceat(sizes, ranges.base[:-1])  # of all digests of a range
            heavy = [i for i in range(len(parts)) if whole[i] > most and (i > 0 and edges[i - 1] < ends[i - 1] or parts[i] == 1)]
            if shards == 1 or not heavy or len(parts) >= 4 * BINS:
                break
            pieces, new = max(2, BINS // len(heavy)), ([], [], [])
            for i in range(len(parts)):
                low, high = (edges[i - 1], ends[i - 1]) if i else (None, None)
                if i not in set(heavy):
                    cuts, n = [(low, high)], parts[i]
                elif i and low < high:
                    width = -(-(high - low + 1) // pieces)
                    cuts, n = [(x, min(high, x + width - 1)) for x in range(low, high + 1, width)], 1
                else:  # one id, or the null ids
                    cuts, n = [(low, high)], min(pieces, -(-int(whole[i]) // most) + 1)
                for c in cuts:
                    new[0].append(c[0])
                    new[1].append(c[1])
                    new[2].append(n)
            edges, ends, parts = new[0][1:], new[1][1:], new[2]
        ranges.shards = np.minimum(shards - 1, (np.cumsum(sizes) - sizes) * shards // max(1, int(sizes.sum())))
        return ranges


def clean_up(root: str) -> None:
    """Remove what attempts that were lost have left."""
    fs, top = filesystems.FileSystem.from_uri(root)
    for f in fs.get_file_info(filesystems.FileSelector(top, allow_not_found=True)):
        if f.base_name.startswith("_temporary-"):
            fs.delete_file(f.path)


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0,
               shards: int | None = None, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write the archives under ``path`` (a URI) and return the manifest, which is at ``path``/manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    root = path if "://" in path or not path.startswith("/") else f"file://{path}"
    root = re.sub(r"^file:/(?!/)", "file:///", root)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    keys = stash(rows.select("page_id", "sha1", F.octet_length("html").cast("long").alias("payload_bytes")), "warc-keys")

    total = keys.agg(F.sum("payload_bytes")).first()[0] or 0
    shards = shards or max(1, -(-total // shard_bytes))
    shard_number = Ranges.of(keys, shards).shard_number()

    hits = revisits(keys, revisit_bytes)
    known = rows.select("page_id", "sha1", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    told = hits.select("page_id", "sha1", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    both = known.unionByName(told).withColumn("shard", shard_number("page_id", "sha1"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller, held, repeat, target, done = None, None, 0, None, []
        for batch in batches:
            for shard, kind, key, sha1, link, text, to in zip(batch["shard"], batch["kind"], batch["page_id"], batch["sha1"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                key = None if key is None else int(key)
                if (key, sha1) != held:
                    held, repeat, target = (key, sha1), 0, None
                if kind == 0:
                    target = (None if to is None else int(to),)
                    continue
                if roller is None or roller.shard != shard:
                    done += list(roller.close()) if roller else []
                    roller = Roller(root, int(shard), file_bytes)
                record = make_record(key, link if isinstance(link, str) else None, text.encode(), target[0] if target else None, target is not None, repeat, date)
                repeat += 1
                done += list(roller.add(record, key))
            if done:
                yield manifest_rows(done)
                done = []
        done += list(roller.close()) if roller else []
        if done:
            yield manifest_rows(done)

    written = both.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "page_id", "sha1", "kind", "url")
    written = written.select("shard", "kind", F.col("page_id").cast("string"), "sha1", "url", "html", F.col("refers_to").cast("string")).mapInPandas(write, MANIFEST)
    written.write.parquet(f"{path}/manifest")
    clean_up(root)
    return spark.read.parquet(f"{path}/manifest")


def manifest_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in MANIFEST.split(", ")])
    return out.astype({"first_page_id": "Int64", "last_page_id": "Int64"})


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, one in memory at a time."""
    raw, data = b"", b""
    unpacker = zlib.decompressobj(31)
    while True:
        raw = raw or stream.read(1 << 16)
        if not raw:
            if data:
                raise ValueError("the archive ends within a record")
            return
        data += unpacker.decompress(raw)
        raw = b""
        if unpacker.eof:
            raw, unpacker = unpacker.unused_data, zlib.decompressobj(31)
            head, _, body = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"no record starts with {lines[0][:40]!r}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            yield headers, body[:int(headers["Content-Length"])]
            data = b""


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the files in the manifest, digests checked; with ``payload`` (binary, null for revisits) if asked for."""
    small_batches(spark)
    root = re.sub(r"^file:/(?!/)", "file:///", path if "://" in path or not path.startswith("/") else f"file://{path}")
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file", "records")
    columns = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payloads

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = filesystems.FileSystem.from_uri(root)
        for batch in batches:
            for name, expected in zip(batch["file"], batch["records"], strict=True):
                out, seen = [], 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        if h["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).digest()):
                            raise ValueError(f"{name}: a block differs from its digest")
                        payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None:
                            if base32(hashlib.sha1(payload).digest()) != digest or len(payload) != int(h["X-Payload-Length"]):
                                raise ValueError(f"{name}: a payload differs from its digest")
                        out.append((h["WARC-Record-ID"], h["WARC-Type"], number(h.get("X-Page-ID")), h.get("WARC-Target-URI"), int(h["X-Payload-Length"]),
                                    digest, number(h.get("X-Refers-To-Page-ID")), name, *[payload] * payloads))
                        seen += 1
                        if len(out) >= 500:
                            yield frame(out)
                            out = []
                if seen != expected:
                    raise ValueError(f"{name}: {seen} records, the manifest has {expected}")
                yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    n = max(1, min(files.count(), 100_000))
    return files.repartition(n, "file").mapInPandas(read, RECORDS + ", payload binary" * payloads)


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages and read them back."""
    path = path or scratch(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
