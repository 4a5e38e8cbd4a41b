"""Directories of archives as a table: `spark.read.format("archive_directory").load(root)`, a row for each member, without reading any member.

Tasks walk subtrees as the tree source does. Of a file the first bytes tell the format, and of a zip archive only the end record and the directory are read; an archive whose directory is beyond the bounds, encrypted in
another sense, or not what its end record says gives one row with a limitation. Other formats give one row each.
"""

from __future__ import annotations

import os
import struct
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from curalis.operators.crates import MOST_MEMBERS, archive_members
from curalis.sources import trees

SCHEMA = "archive string, format string, limitation string, ordinal int, name string, flag_bits int, compress_size long, file_size long, crc long"
ARROW = pa.schema([("archive", pa.string()), ("format", pa.string()), ("limitation", pa.string()), ("ordinal", pa.int32()), ("name", pa.string()), ("flag_bits", pa.int32()), ("compress_size", pa.int64()), ("file_size", pa.int64()), ("crc", pa.int64())])
# fixed values: the archive format's records, how far from the end its last one may begin, and the largest directory that is read
END, ENTRY = "<4s4H2LH", "<4s4B4H3L5H2L"
END_SIZE, ENTRY_SIZE = 22, 46
END_MARK, ENTRY_MARK = b"PK\x05\x06", b"PK\x01\x02"
SEARCH = 65_557
MAX_DIRECTORY = 1024 * 1024
HEADS = ((b"PK\x03\x04", "ZIP"), (b"PK\x05\x06", "ZIP"), (b"7z\xbc\xaf\x27\x1c", "7Z"), (b"Rar!\x1a\x07", "RAR"))
MALFORMED, BEYOND, OPAQUE = "ARCHIVE_MALFORMED", "RESOURCE_LIMIT_REACHED", "UNSUPPORTED_FORMAT"


class Fault(Exception):
    """Why an archive's directory is not listed."""


def kind_of(head: bytes) -> str | None:
    return next((k for mark, k in HEADS if head.startswith(mark)), "TAR" if head[257:262] == b"ustar" else None)


def directory(f, size: int) -> tuple[bytes, int]:
    """(bytes of the directory, number of entries) by the end record."""
    tail = min(size, SEARCH)
    f.seek(size - tail)
    last = f.read(tail)
    at = last.rfind(END_MARK)
    if at < 0 or at + END_SIZE > len(last):
        raise Fault(MALFORMED)
    _, disk, first_disk, here, entries, length, offset, comment = struct.unpack_from(END, last, at)
    if disk or first_disk or here != entries or at + END_SIZE + comment != len(last):
        raise Fault(MALFORMED)
    if entries > min(MOST_MEMBERS, 0xFFFE) or length > MAX_DIRECTORY or offset == 0xFFFFFFFF:
        raise Fault(BEYOND)
    end = size - tail + at
    if offset + length > end:
        raise Fault(MALFORMED)
    f.seek(end - length)  # what stands before the archive shifts its offsets, but not the directory from the end record
    return f.read(length), entries


def members(data: bytes) -> Iterator[tuple]:
    """(name, flag_bits, compress_size, file_size, crc) of a directory's entries, by its length: the count of the end record is not asked."""
    at = 0
    while at < len(data):
        if len(data) - at < ENTRY_SIZE:
            raise Fault(MALFORMED)
        x = struct.unpack_from(ENTRY, data, at)
        flags, crc, packed, whole, name, extra, comment = x[5], x[9], x[10], x[11], x[12], x[13], x[14]
        raw = data[at + ENTRY_SIZE : at + ENTRY_SIZE + name]
        if x[0] != ENTRY_MARK or x[3] > 63:
            raise Fault(MALFORMED)
        try:
            text = raw.decode("utf-8" if flags & 0x800 else "cp437").split("\0")[0]
        except UnicodeDecodeError:
            raise Fault(MALFORMED) from None
        yield text, flags, packed, whole, crc
        at += ENTRY_SIZE + name + extra + comment


class ArchiveReader(trees.TreeReader):
    def archive(self, path: bytes) -> Iterator[tuple]:
        name, full = trees.shown(path), os.path.join(self.root, path)
        none = (None,) * 6
        try:
            with open(full, "rb", 0) as f:
                kind = kind_of(f.read(512))
                if kind is None:
                    return
                if kind != "ZIP":
                    yield name, kind, OPAQUE, *none
                    return
                data, _ = directory(f, os.fstat(f.fileno()).st_size)
            found = list(members(data))
        except Fault as e:
            yield name, "ZIP", str(e), *none
        except OSError:
            yield name, "ZIP", MALFORMED, *none
        else:
            for i, m in enumerate(found):
                yield name, "ZIP", None, i, *m
            if not found:
                yield name, "ZIP", None, *none

    def rows(self, part: trees.Subtree) -> Iterator[tuple]:
        for r in super().rows(part):
            if r[2] == "REGULAR_FILE":
                yield from self.archive(r[1])

    def read(self, partition: trees.Subtree) -> Iterator[pa.RecordBatch]:
        batch = []
        for r in self.rows(partition):
            batch.append(r)
            if len(batch) == trees.BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), ARROW.types)], schema=ARROW)
                batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), ARROW.types)], schema=ARROW)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, root: str, **options) -> DataFrame:
    cloudpickle.register_pickle_by_value(trees)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_directory").options(**{k: str(v) for k, v in options.items()}).load(root)


def observations(rows: DataFrame) -> DataFrame:
    """(archive, format, status, limitation, member_count, member_manifest_id) of every archive: those listed by the rules of members, the others by why they are not."""
    listed = archive_members(rows.filter("ordinal is not null").select("archive", "ordinal", "name", "flag_bits", "compress_size", "file_size", "crc")).withColumn("format", F.lit("ZIP"))
    empty = F.concat(F.lit("zip-manifest-v1:"), F.sha2(F.lit("[]"), 256))
    status = F.when(F.col("format") != "ZIP", "OPAQUE").when(F.col("limitation").isNull(), "INSPECTED").otherwise("LIMITED")
    bare = F.col("limitation").isNull()
    rest = rows.filter("ordinal is null").select("archive", "format", status.alias("status"), "limitation", F.when(bare, F.lit(0).cast("long")).alias("member_count"), F.when(bare, empty).alias("member_manifest_id"))
    return listed.select(*rest.columns).unionByName(rest)
