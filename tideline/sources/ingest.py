"""Reading panels: explicit schemas, projections, gates and guards."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file with header, pruned to ``columns``."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def read_csv_lenient(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Well-formed lines, and the malformed ones (``_corrupt_record``): every line but the header is in one of
    them. A line is malformed if it has too many or too few cells or one that its type does
    not hold, whatever columns are selected afterwards: both sides come from one reading of all cells."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.schema(wide).option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False).csv(path)
    # always true, but Spark does not know: so all columns are needed, and the reader parses whole lines
    lines = lines.where(F.hash(*(f"`{f.name}`" for f in schema.fields)) <= 2147483647)
    return lines.where("_corrupt_record is null").drop("_corrupt_record"), lines.where("_corrupt_record is not null").select("_corrupt_record")


def trimmed(df: DataFrame) -> DataFrame:
    """Column names and string cells without white space around them."""
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.select(*(F.trim(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema))


def headers(spark: SparkSession, pattern: str, exclude: str | None = None) -> dict[tuple[str, ...], list[str]]:
    """The files of a pattern by their header (names without white space around them), but those whose name
    matches ``exclude``. Only the first line of each file is read; files without one are left out."""
    jvm, conf = spark._jvm, spark._jsc.sc().hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found = [f.getPath() for f in (fs.globStatus(path) or []) if f.isFile()]
    found = [f for f in found if not f.getName().startswith(("_", ".")) and not (exclude and re.search(exclude, f.getName()))]

    def head(at) -> str | None:
        codec, stream = codecs.getCodec(at), fs.open(at)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            return reader.readLine()
        finally:
            reader.close()

    out: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for at, line in zip(found, pool.map(head, found), strict=True):
            if line:
                names = tuple(c.strip() for c in next(csv.reader([line.lstrip("\ufeff")])))
                if len(set(names)) < len(names):
                    raise ValueError(f"a column occurs twice in {at}")
                out.setdefault(names, []).append(at.toString())
    return out


def read_csvs(spark: SparkSession, pattern: str, exclude: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """All files of a pattern by header name, but those whose name matches ``exclude``. Files of one
    header are one scan; scans are united by name, and what a file lacks is null. Columns of
    ``schema`` get its types, others are text. Without any file with a header, an error."""
    kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
    scans = []
    for names, paths in sorted(headers(spark, pattern, exclude).items()):
        own = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in names])
        scans.append(spark.read.schema(own).option("header", True).option("enforceSchema", True).csv(paths))
    if not scans:
        raise FileNotFoundError(f"no file with a header: {pattern}")
    return union_all(scans)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name; what a frame lacks is null."""
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, or KeyError with the columns that it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise KeyError(f"columns missing: {', '.join(lacking)}")
    return df


def gated(df: DataFrame, gated_columns: Sequence[str], ask: Sequence[str] | None = None, include: bool = False) -> DataFrame:
    """Leave out columns that read the row itself, unless they are asked for as a whole;
    naming one without ``include`` is an error."""
    if include:
        return require(df, gated_columns) if ask is None else df.select(*ask)
    if ask and (wrong := [c for c in ask if c in gated_columns]):
        raise KeyError(f"these columns read the row itself: {', '.join(wrong)}")
    return df.select(*(c for c in (ask or df.columns) if c not in gated_columns))


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating-point column."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*(finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema))
