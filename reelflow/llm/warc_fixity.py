"""Fixity audit of web archives by Merkle trees over ordered offset ranges.

A volume is a run of WARC records; a leaf is a record's offset, length and SHA-256. Leaves whose offset
falls into the same range of ``RANGE`` bytes form a node, ``FANOUT`` neighbouring nodes form the next, up
to one root a volume. Two replicas are compared by roots; only children of nodes that differ are joined,
level by level, down to the records: equal volumes cost one row each.

A node hashes its children's lines in order of position, at most ``RANGE`` / the shortest record or
``FANOUT`` of them, so no group grows with the archive. Volumes hold ``VOLUME_PAGES`` consecutive ids.

Nulls: a null url or html counts as empty; pages with a null id are dealt by url over ``SPARE_VOLUMES`` volumes
below zero. Repeated rows are records of their own, ordered by id, url, length and digest. An empty table has
no volumes. A page of any length is one record. Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.llm.common import stage

VOLUME_PAGES = 4096
RANGE = 1 << 16
FANOUT = 16
#: Volumes of pages without an id.
SPARE_VOLUMES = 1024


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record, as binary."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def _spare(url: str) -> Column:
    """The volume of a page without id, from -1 down, by its url."""
    return -1 - F.conv(F.substring(F.md5(F.coalesce(F.col(url), F.lit(""))), 1, 4), 16, 10).cast("long") % SPARE_VOLUMES


def leaves(pages: DataFrame, damage: Column | None = None) -> DataFrame:
    """(volume, offset, length, sha256, page_id) of the records of ``pages``.

    ``damage``: a condition on page_id under which the record's last body byte is replaced, as a drill.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    raw = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    size = F.octet_length(raw).cast("long")
    if damage is not None:
        raw = F.when(damage, F.concat(F.substring(raw, 1, F.octet_length(raw) - 5), F.lit("?\r\n\r\n").cast("binary"))).otherwise(raw)
    rows = rows.select("page_id", "url", F.coalesce(F.floor(F.col("page_id") / VOLUME_PAGES), _spare("url")).cast("long").alias("volume"), size.alias("length"), F.sha2(raw, 256).alias("sha256"))
    before = Window.partitionBy("volume").orderBy("page_id", "url", "length", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("volume", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "sha256", "page_id")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels (volume, node, digest) from the ranges up to the roots, where node is 0 in every volume.

    The number of levels follows from the largest offset of all volumes, so both replicas' trees must be
    made with ``levels_for`` of both; a tree may be higher than a small volume needs.
    """
    return _levels(records, levels_for(records))


def levels_for(*replicas: DataFrame) -> int:
    top = max((r.agg(F.max("offset")).first()[0] or 0) // RANGE for r in replicas)
    n = 1
    while top > 0:
        top //= FANOUT
        n += 1
    return n


def _levels(records: DataFrame, n: int) -> list[DataFrame]:
    line = F.concat_ws(":", F.col("offset"), F.col("length"), F.col("sha256"))
    out = [_level(records.select("volume", F.floor(F.col("offset") / RANGE).alias("node"), F.col("offset").alias("place"), line.alias("line")))]
    for _ in range(n - 1):
        below = out[-1]
        out.append(_level(below.select("volume", F.floor(F.col("node") / FANOUT).alias("node"), F.col("node").alias("place"), F.concat_ws(":", "node", "digest").alias("line"))))
    return out


def _level(children: DataFrame) -> DataFrame:
    """A level, staged: the next one and the descent read it, neither makes it anew."""
    return stage(_nodes(children), "tree")


def _nodes(children: DataFrame) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    return children.groupBy("volume", "node").agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("digest"))


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left, right = a.select(*keys, F.col("digest").alias("digest_a")), b.select(*keys, F.col("digest").alias("digest_b"))
    return left.join(right, keys, "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select(*keys)


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(volume, offset, length, status) of records that differ: ``corrupt``, ``missing`` or ``extra`` in the replica."""
    n = levels_for(primary, replica)
    mine, other = (_levels(x, n) for x in (primary, replica))
    return descend(primary, replica, mine, other)


def descend(primary: DataFrame, replica: DataFrame, mine: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """As ``audit``, with both trees given."""
    bad = stage(_differing(mine[-1], other[-1], ["volume", "node"]), "differing")
    if bad.isEmpty():  # equal roots: nothing below is looked at
        mine, other, primary, replica = mine[-1:], other[-1:], primary.limit(0), replica.limit(0)
    for a, b in zip(mine[-2::-1], other[-2::-1], strict=True):
        below = [x.withColumn("up", F.floor(F.col("node") / FANOUT)).join(bad.withColumnRenamed("node", "up"), ["volume", "up"], "left_semi") for x in (a, b)]
        bad = stage(_differing(*below, ["volume", "node"]), "differing")
    own, its = (x.withColumn("node", F.floor(F.col("offset") / RANGE)).join(bad, ["volume", "node"], "left_semi") for x in (primary, replica))
    both = own.select("volume", "offset", F.col("length").alias("length_a"), F.col("sha256").alias("a")).join(its.select("volume", "offset", F.col("length").alias("length_b"), F.col("sha256").alias("b")), ["volume", "offset"], "full")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return both.where(~(F.col("a").eqNullSafe(F.col("b")) & F.col("length_a").eqNullSafe(F.col("length_b")))).select("volume", "offset", F.coalesce("length_a", "length_b").alias("length"), status.alias("status"))


def audited(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The primary's records with range_sha256, root_sha256 and status (``ok`` where nothing differs).

    Records that only the replica has are in ``audit``, not here.
    """
    primary, replica = stage(primary, "primary"), stage(replica, "replica")
    n = levels_for(primary, replica)
    mine, other = _levels(primary, n), _levels(replica, n)
    bad = descend(primary, replica, mine, other).where("status <> 'extra'").select("volume", "offset", "status")
    rows = primary.withColumn("node", F.floor(F.col("offset") / RANGE))
    rows = rows.join(mine[0].withColumnRenamed("digest", "range_sha256"), ["volume", "node"]).join(mine[-1].select("volume", F.col("digest").alias("root_sha256")), "volume")
    return rows.join(bad, ["volume", "offset"], "left").select("page_id", "volume", "offset", "length", "sha256", "range_sha256", "root_sha256", F.coalesce("status", F.lit("ok")).alias("status"))


def split_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each record of an uncompressed WARC volume; what follows a broken record is one last piece."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        length = None
        if head >= 0 and data.startswith(b"WARC/", at):
            for line in data[at:head].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    length = int(value)
        end = len(data) if length is None else min(len(data), head + 4 + length + 4)
        yield at, data[at:end]
        at = end


def split_members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each gzip member; what follows a broken one is one last piece."""
    at = 0
    while at < len(data):
        member, end = zlib.decompressobj(31), at
        try:
            while not member.eof and end < len(data):
                member.decompress(data[end : end + (1 << 16)])
                end += 1 << 16
            end = min(end, len(data)) - len(member.unused_data)
        except zlib.error:
            end = len(data)
        yield at, data[at:end]
        at = end


def read_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of the WARC volumes in ``folder``, named ``volume-<number>.warc`` or ``.warc.gz`` (a member a record).

    The digest is of the bytes as they are stored. A task holds one volume at a time.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, data in zip(files["path"], files["content"], strict=True):
                volume = int(path.rsplit("volume-", 1)[1].split(".")[0])
                rows = [(volume, at, len(x), hashlib.sha256(x).hexdigest()) for at, x in (split_members if path.endswith(".gz") else split_records)(bytes(data))]
                yield pd.DataFrame(rows, columns=["volume", "offset", "length", "sha256"])

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, "volume long, offset long, length long, sha256 string")
