"""Files to the ``docs`` table.

``files`` has ``path, raw, ctime, mtime`` (and ``size``, else the length of raw).  Formats
that need a scanner go through one Arrow pass over the files; plain text tables need none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EXTENSIONS, Settings
from ..functions.dates import parse_date
from ..functions.fold import fold_column, fold_field_column, words_column
from . import formats, markdown

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


DOCS = _struct(
    id=_L, path=_S, title=_S, folder=_S, title_norm=_S, path_norm=_S, text=_S, text_b=_S, offset_map=T.ArrayType(_I),
    frontmatter=_struct(start=_I, end=_I),
    headings=T.ArrayType(_struct(level=_I, start=_I, end=_I, text_start=_I, text_end=_I)),
    block_breaks=T.ArrayType(_I), tags=T.ArrayType(_S), words=T.ArrayType(_S), properties=T.MapType(_S, _S),
    has_open_task=T.BooleanType(), format=_S, created_at=_L, created_source=_S, modified_at=_L, indexed_mtime=_L,
    size=_L, raw=_S,
)


def format_column(path: Column) -> Column:
    """Format by the extension, null if it is none of the known."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, kind in EXTENSIONS.items():
        out = F.when(ext == name, kind).otherwise(out)
    return out


def folder_column(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def title_column(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def inside(path: Column, folder: str) -> Column:
    """Whether a path is the folder or under it, by whole segments."""
    return (path == folder) | path.startswith(folder + "/")


def excluded(path: Column, folders) -> Column:
    out = F.lit(False)
    for f in folders:
        name = f.strip().strip("/") if isinstance(f, str) else ""
        if name:
            out |= inside(path, name)
    return out


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root``, of the known formats; times are those of the store."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    millis = F.unix_millis("modificationTime")
    return found.select(
        F.substring(path, F.length(base) + 2, F.lit(1 << 30)).alias("path"),
        F.col("content").cast("string").alias("raw"),
        millis.alias("ctime"),
        millis.alias("mtime"),
        F.col("length").alias("size"),
    ).filter(format_column(F.col("path")).isNotNull())


def live_files(files: DataFrame, settings: Settings) -> DataFrame:
    """Files to be indexed: of an indexed format and in no excluded folder."""
    return files.filter(format_column(F.col("path")).isin(*settings.formats) & ~excluded(F.col("path"), settings.excluded_folders))




def _extract(fields: list[str], created_field: str, zone: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(DOCS)
    key = markdown.created_key(created_field)
    keys = ("start", "end"), ("level", "start", "end", "text_start", "text_end")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                d = formats.extract(r["format"], r["raw"] or "", created_field)
                when = parse_date(d.properties.get(key, ""), zone)
                r |= {
                    "text": d.text,
                    "text_b": d.with_barriers(),
                    "offset_map": d.offset_map,
                    "frontmatter": dict(zip(keys[0], d.frontmatter)) if d.frontmatter else None,
                    "headings": [dict(zip(keys[1], h)) for h in d.headings],
                    "block_breaks": d.breaks,
                    "tags": d.tags,
                    "words": d.words,
                    "properties": list(d.properties.items()),
                    "has_open_task": d.open_task,
                    "created_at": r["ctime"] if when is None else when,
                    "created_source": "ctime" if when is None else "frontmatter",
                }
                del r["ctime"]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def build_docs(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The ``docs`` table of the files that are to be indexed."""
    zone = files.sparkSession.conf.get("spark.sql.session.timeZone")
    size = F.col("size").cast("long") if "size" in files.columns else F.octet_length("raw").cast("long")
    named = live_files(files, settings).select(
        F.xxhash64("path").alias("id"),
        "path",
        title_column(F.col("path")).alias("title"),
        folder_column(F.col("path")).alias("folder"),
        fold_field_column(title_column(F.col("path"))).alias("title_norm"),
        fold_field_column(F.col("path")).alias("path_norm"),
        format_column(F.col("path")).alias("format"),
        F.col("mtime").alias("modified_at"),
        F.col("mtime").alias("indexed_mtime"),
        size.alias("size"),
        "raw",
        "ctime",
    )
    return named.mapInArrow(_extract(DOCS.fieldNames(), settings.created_field, zone), DOCS)


def plain_docs(rows: DataFrame) -> DataFrame:
    """``docs`` from a table of plain texts, in built-in functions alone.

    ``rows`` has ``path, raw, ctime, mtime`` and may have ``tags`` (array), ``properties``
    (map) and ``format``.  There are no headings, breaks, tasks or frontmatter.
    """
    have = set(rows.columns)
    text = fold_column(F.regexp_replace("raw", r"[\r\n\t]", " "))
    empty = F.array().cast("array<string>")
    values = {
        "id": F.xxhash64("path"),
        "path": F.col("path"),
        "title": title_column(F.col("path")),
        "folder": folder_column(F.col("path")),
        "title_norm": fold_field_column(title_column(F.col("path"))),
        "path_norm": fold_field_column(F.col("path")),
        "text": text,
        "text_b": text,
        "tags": F.col("tags") if "tags" in have else empty,
        "words": words_column(text),
        "properties": F.col("properties") if "properties" in have else F.create_map().cast("map<string,string>"),
        "has_open_task": F.lit(False),
        "format": F.col("format") if "format" in have else F.lit("markdown"),
        "created_at": F.col("ctime"),
        "created_source": F.lit("ctime"),
        "modified_at": F.col("mtime"),
        "indexed_mtime": F.col("mtime"),
        "size": F.octet_length("raw").cast("long"),
        "raw": F.col("raw"),
    }
    none = {f.name: F.lit(None) if f.name not in ("headings", "block_breaks") else F.array() for f in DOCS if f.name not in values}
    return rows.select(*((values | none)[f.name].cast(f.dataType).alias(f.name) for f in DOCS))
