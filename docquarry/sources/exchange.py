"""Files: JSON export and import, snapshots, backups, and changelogs with checksums."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.values import decrypt, encrypt, spare
from docquarry.operators.structures import running_before
from docquarry.session import ship
from docquarry.sources.shared import remove

#: Backups that are kept, the most a changelog file holds, and a changelog's columns.
KEPT, SEGMENT_BYTES = 5, 100 * 1024 * 1024
ENTRY = "sequence long, timestamp timestamp_ntz, op string, collection string, doc_id string, changes string"


def export_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    """Write documents as JSON, a line each; pretty spreads a document over lines (then read with multi-line parsing)."""
    if pretty:
        df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)
    else:
        df.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: T.StructType | str, pretty: bool = False) -> DataFrame:
    if pretty:
        text = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''")
        return text.select(F.from_json("value", schema).alias("d")).select("d.*")
    return spark.read.schema(schema).json(path)


def imported(current: DataFrame, new: DataFrame, replace: bool, id_column: str = "_id") -> DataFrame:
    """A collection after an import: the new documents alone, or over the current ones by id."""
    if replace:
        return new
    return current.join(new.select(id_column).distinct(), id_column, "left_anti").unionByName(new, allowMissingColumns=True)


def import_dynamic(spark: SparkSession, path: str, id_field: str = "_id") -> DataFrame:
    """JSON lines of any shape as (_id, doc): doc is a VARIANT, in which a null and a missing field differ."""
    lines = spark.read.text(path).select(F.parse_json("value").alias("doc"))
    return lines.select(F.try_variant_get("doc", f"$.{id_field}", "string").alias("_id"), "doc")


def write_snapshot(df: DataFrame, root: str, collection: str, sequence: int) -> None:
    """A collection as of a sequence number, with a checksum over its rows in a manifest beside it."""
    target = f"{root}/seq={sequence:012d}/collection={collection}"
    df.write.mode("overwrite").parquet(f"{target}/data")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{target}/data")
    digest(written).withColumn("sequence", F.lit(sequence)).withColumn("collection", F.lit(collection)).coalesce(1).write.mode("overwrite").json(f"{target}/manifest")


def digest(df: DataFrame) -> DataFrame:
    """One row, (documents, checksum): the exclusive or of row hashes, so that order doesn't matter."""
    return df.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.bit_xor(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])), F.lit(0)).alias("checksum"))


def read_snapshot(spark: SparkSession, root: str, collection: str, sequence: int, schema: T.StructType | None = None, verify: bool = True) -> DataFrame:
    target = f"{root}/seq={sequence:012d}/collection={collection}"
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(f"{target}/data")
    if verify:
        found, want = digest(df).first(), spark.read.schema("documents long, checksum long").json(f"{target}/manifest").first()
        if (found.documents, found.checksum) != (want.documents, want.checksum):
            raise ValueError(f"snapshot {sequence} of {collection} doesn't fit its manifest")
    return df


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(sequence, collection, documents, checksum) of the snapshots under root, newest first."""
    read = spark.read.schema("documents long, checksum long, sequence long, collection string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    return read.json(root).where("sequence is not null").select("sequence", "collection", "documents", "checksum").orderBy(F.desc("sequence"), "collection")


def create_backup(df: DataFrame, root: str, collection: str, sequence: int, created_at: str, kept: int = KEPT) -> None:
    """Back up a collection as of a sequence number, then remove the oldest backups beyond `kept`."""
    spark, target = df.sparkSession, f"{root}/backup-{created_at}-{sequence:012d}"
    write_snapshot(df, target, collection, sequence)
    about = spark.createDataFrame([(f"backup-{created_at}-{sequence:012d}", created_at, collection, sequence)], "backup_id string, created_at string, collection string, sequence long")
    about.coalesce(1).write.mode("overwrite").json(f"{root}/about/{created_at}-{sequence:012d}")
    for row in retained(backups(spark, root), kept).where("not kept").collect():
        remove(spark, f"{root}/{row.backup_id}")
        remove(spark, f"{root}/about/{row.created_at}-{row.sequence:012d}")


def backups(spark: SparkSession, root: str) -> DataFrame:
    """(backup_id, created_at, collection, sequence) of the backups under root, newest first."""
    read = spark.read.schema("backup_id string, created_at string, collection string, sequence long")
    return read.option("recursiveFileLookup", "true").json(f"{root}/about").orderBy(F.desc("created_at"), F.desc("backup_id"))


def verify_backup(spark: SparkSession, root: str, backup_id: str) -> bool:
    """Whether a backup is there and its rows fit its manifest."""
    row = backups(spark, root).where(F.col("backup_id") == backup_id).first()
    if row is None:
        return False
    try:
        return read_snapshot(spark, f"{root}/{backup_id}", row.collection, row.sequence) is not None
    except (ValueError, AnalysisException):
        return False


def restore_backup(spark: SparkSession, root: str, backup_id: str) -> tuple[DataFrame, int]:
    """(rows, sequence) of a verified backup; ValueError without one."""
    row = backups(spark, root).where(F.col("backup_id") == backup_id).first()
    if row is None:
        raise ValueError(f"no backup {backup_id}")
    return read_snapshot(spark, f"{root}/{backup_id}", row.collection, row.sequence), row.sequence


def retained(backups: DataFrame, kept: int = KEPT) -> DataFrame:
    """backups (backup_id, created_at, ...) with rank, newest first, and kept."""
    rank = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("backup_id")))
    return backups.withColumn("rank", rank).withColumn("kept", F.col("rank") <= kept)


def body(df: DataFrame) -> F.Column:
    """What an entry's checksum is over."""
    return F.to_json(F.struct(*[c.split()[0] for c in ENTRY.split(", ")]), {"ignoreNullFields": "false"})


def sealed(entries: DataFrame) -> DataFrame:
    """entries (columns of ENTRY) with their checksum."""
    return entries.withColumn("checksum", F.crc32(body(entries).cast("binary")))


def segments(entries: DataFrame, limit: int = SEGMENT_BYTES) -> DataFrame:
    """entries with segment: the file of a log that rotates once its entries in order of sequence fill `limit` bytes."""
    size, before = spare(entries, "size", "before")
    sized = entries.withColumn(size, F.octet_length(body(entries)).cast("long"))
    out = running_before(sized, [F.col("sequence")], size).withColumnRenamed("before", before)
    return out.withColumn("segment", F.floor(F.col(before) / limit).cast("long")).drop(size, before)


def append_changelog(entries: DataFrame, path: str, limit: int = SEGMENT_BYTES) -> None:
    """Append entries with their checksums, in a folder for each segment that they fill."""
    out = sealed(segments(entries, limit))
    out.repartition("segment").sortWithinPartitions("segment", "sequence").write.mode("append").partitionBy("segment").parquet(path)


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY + ", checksum long, segment long").parquet(path)


def changelog_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, last, entries) of a changelog's files, in order of their names."""
    rows = read_changelog(spark, path).select(F.input_file_name().alias("file"), "sequence")
    return rows.groupBy("file").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count(F.lit(1)).alias("entries")).orderBy("file")


def damaged(entries: DataFrame) -> DataFrame:
    """Entries whose checksum doesn't fit."""
    return entries.where(F.crc32(body(entries).cast("binary")) != F.col("checksum"))


def frames(documents: list[dict]) -> bytes:
    """Entries as framed bytes: length (4 bytes, little endian), JSON, CRC-32 (4 bytes)."""
    out = []
    for d in documents:
        data = json.dumps(d, separators=(",", ":")).encode()
        out.append(struct.pack("<I", len(data)) + data + struct.pack("<I", zlib.crc32(data)))
    return b"".join(out)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Framed changelog files as (file, place, json, intact): files are read apart; a cut frame ends its file, with intact false."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows, at, content = [], 0, bytes(content)
                while at < len(content):
                    size = struct.unpack_from("<I", content, at)[0] if at + 4 <= len(content) else len(content)
                    data, tail = content[at + 4 : at + 4 + size], content[at + 4 + size : at + 8 + size]
                    whole = len(tail) == 4 and zlib.crc32(data) == struct.unpack("<I", tail)[0]
                    rows.append((file, len(rows), data.decode("utf-8", "replace"), whole))
                    at = at + 8 + size if len(tail) == 4 else len(content)
                yield pd.DataFrame(rows, columns=["file", "place", "json", "intact"])

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, place long, json string, intact boolean")


def compactable(entries: DataFrame, threshold: int) -> DataFrame:
    """(file) of changelog entries (file, sequence) whose entries are all below the threshold, without the newest file."""
    spans = entries.groupBy("file").agg(F.max("sequence").alias("top"))
    newest = spans.agg(F.max("top").alias("newest"))
    return spans.where(F.col("top") < threshold).join(newest, F.col("top") == F.col("newest"), "left_anti").select("file")


def encrypted_changelog(entries: DataFrame, key: Column) -> DataFrame:
    """Sealed entries whose changes are encrypted; the checksum is over what is stored."""
    return sealed(entries.withColumn("changes", F.base64(encrypt(F.col("changes"), key))))


def decrypted_changelog(entries: DataFrame, key: Column) -> DataFrame:
    """The entries of an encrypted changelog with their changes in clear; null where the key doesn't fit."""
    return entries.withColumn("changes", decrypt(F.unbase64("changes"), key))
