"""Files and archives as tables: catalog, zip entries, gzip and zlib contents.

All of them read through Spark's binaryFile source, so any store that Spark reaches will do.
"""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that are no traces.
DENIED = ["build-description.json", "build-request.json", "manifest.json"]
DENIED_ENDS = ["diagnostic-filename-map.json", ".abi.json", "-OutputFileMap.json", "_const_extract_protocols.json"]


def _extension(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^./]*)$", 1)


def container_type(name: Column) -> Column:
    return F.when(_extension(name) == "zip", "archive").when(_extension(name) == "gz", "compressed").otherwise("file")


def file_type(name: Column) -> Column:
    inner = _extension(F.regexp_replace(name, r"(\.(gz|zip))+$", ""))
    return F.when(inner.isin("json", "buildtrace"), "build").when(inner == "memtrace", "memory").when(inner.isin("trace", "perftrace"), "perf").otherwise("unknown")


def is_supported(path: Column) -> Column:
    base, ext = F.substring_index(path, "/", -1), _extension(path)
    denied = base.isin(DENIED)
    for end in DENIED_ENDS:
        denied = denied | base.endswith(end)
    return ~base.startswith("._") & (ext.isin("gz", "zip", "perftrace", "trace", "memtrace") | (ext.isin("json", "buildtrace") & ~denied))


def files(spark: SparkSession, path: str, hidden: bool = False) -> DataFrame:
    """(path, name, folder, modified, length, file_type, container_type) of a folder and all below it; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    name = F.substring_index("path", "/", -1)
    rows = found.select("path", name.alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("modificationTime").alias("modified"), "length", file_type(F.col("path")).alias("file_type"), container_type(F.col("path")).alias("container_type"))
    return rows if hidden else rows.where(~F.col("name").startswith("."))


def listing(catalog: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(path, name, folder, archive, length): files of a catalog, then entries of zip_entries(), whose path is archive/name."""
    out = catalog.select("path", "name", "folder", F.lit(None).cast("string").alias("archive"), "length")
    if entries is None:
        return out
    whole = F.concat_ws("/", "path", "filename")
    inside = entries.where("filename is not null").select(whole.alias("path"), F.substring_index("filename", "/", -1).alias("name"), F.regexp_replace(whole, "/[^/]*$", "").alias("folder"), F.col("path").alias("archive"), F.col("uncompressed_size").alias("length"))
    return out.unionByName(inside)


def same_group(catalog: DataFrame, selected: str) -> DataFrame:
    """Rows of the selected path's archive, if it is in one and the catalog is a listing(), else of its folder."""
    chosen = catalog.where(F.col("path") == selected)
    if "archive" not in catalog.columns:
        return catalog.join(chosen.select("folder").distinct(), "folder", "left_semi")
    key = F.when(F.col("archive").isNotNull(), F.concat(F.lit("a"), "archive")).otherwise(F.concat(F.lit("f"), "folder"))
    return catalog.withColumn("__key", key).join(chosen.select(key.alias("__key")).distinct(), "__key", "left_semi").drop("__key")


_ENTRIES = "path string, filename string, file_index int, uncompressed_size long, compressed_size long, modified long, crc32 long, content binary, error string"


def _list(with_content: bool, head: int | None, wanted: str | None, extensions: list[str] | None):
    def of(path, data):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            found = {e.filename: k for k, e in enumerate(z.infolist())}
            names = sorted(found) if wanted is None else [wanted] if wanted in found else []
            for name in names:
                e = z.getinfo(name)
                if e.is_dir() or name.endswith(".zip") or (extensions and not name.endswith(tuple(extensions))):
                    continue
                stamp = int(pd.Timestamp(*e.date_time).timestamp())
                content = None
                if with_content:
                    with z.open(e) as f:
                        content = f.read() if head is None else f.read(head)
                yield path, name, found[name], e.file_size, e.compress_size, stamp, e.CRC, content, None

    def run(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    rows += of(path, data)
                except (zipfile.BadZipFile, zlib.error, ValueError) as e:  # a bad archive becomes a row that says so
                    rows.append((path, *[None] * 7, str(e)))
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _ENTRIES.split(", ")], dtype=object)
                yield frame

    return run


def zip_entries(archives: DataFrame, content: bool = False, head: int | None = None, extensions: list[str] | None = None, name: str | None = None) -> DataFrame:
    """archives (path, content) -> one row per entry, in name order within an archive; folders and inner archives are skipped.

    content: also the bytes, or their first `head`. extensions: only entries with one of these endings. name: only that entry; no other is inflated.
    """
    found = archives.select("path", "content").mapInPandas(_list(content, head, name, extensions), _ENTRIES)
    return found if content else found.drop("content")


def zip_lookup(archives: DataFrame, name: str) -> DataFrame:
    """The entry of that name in each archive, found in its directory."""
    return zip_entries(archives, content=True, name=name)


def little_endian(content: Column, at: int, size: int) -> Column:
    """Unsigned integer of up to 7 bytes at an offset of a binary column."""
    part = lambda k: F.conv(F.hex(F.substring(content, at + k + 1, 1)), 16, 10).cast("bigint") * F.lit(256**k)
    out = part(0)
    for k in range(1, size):
        out = out + part(k)
    return out


def padded(n: Column, to: int = 4) -> Column:
    """n rounded up to a multiple of `to`, as typed reads skip."""
    return (F.ceil(n / to) * to).cast("bigint")


@F.pandas_udf(T.BinaryType())
def gunzip(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else gzip.decompress(x))


@F.pandas_udf(T.BinaryType())
def gzip_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else gzip.compress(x, mtime=0))


@F.pandas_udf(T.BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.compress(x, wbits=-15))


@F.pandas_udf(T.BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.decompress(x, -15))


@F.pandas_udf(T.BinaryType())
def zlib_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.compress(x))


@F.pandas_udf(T.BinaryType())
def unzlib(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.decompress(x))


def kind_by_magic(content: Column) -> Column:
    """Container by its first bytes."""
    start = F.hex(F.substring(content, 1, 12))
    return F.when(start == "AB4B5458203131BB0D0A1A0A", "ktx").when(start == "AB4B5458203230BB0D0A1A0A", "ktx2").when(start.startswith("44445320"), "dds").when(start.startswith("89504E470D0A1A0A"), "png").when(start.startswith("504B0304"), "zip").when(start.startswith("1F8B"), "gz").otherwise("unknown")
