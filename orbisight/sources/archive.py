"""Tables kept on a shared store: archives that are checked when read, event logs that are replayed, results kept by identity."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .lineage import shared_folder

FORMAT = 2


def told(value: Column, kind: T.DataType) -> Column:
    """A value as text that only this value has: its length before it, '~' for null; elements of arrays, maps and structs likewise."""
    if isinstance(kind, T.StructType):
        text = F.concat(*[told(value.getField(f.name), f.dataType) for f in kind]) if kind.fields else F.lit("")
    elif isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(value, lambda x: told(x, kind.elementType)), "")
    elif isinstance(kind, T.MapType):
        pair = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        text = F.array_join(F.array_sort(F.transform(F.map_entries(value), lambda x: told(x, pair))), "")
    else:
        text = F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")
    return F.when(value.isNull(), F.lit("~")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def schema_of(df: DataFrame) -> str:
    """Names and types of the columns, by name."""
    return json.dumps(sorted([f.name, f.dataType.simpleString()] for f in df.schema))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row, its columns by name."""
    fields = sorted(df.schema, key=lambda f: f.name)
    return F.sha2(F.concat(F.lit(""), *[told(F.col(f"`{f.name}`"), f.dataType) for f in fields]), 256)


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest): two sums of 60 bits of every row's digest, which don't depend on the order of rows and are added up in parts."""
    half = lambda at: F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(half(at)), F.lit(0)).cast("string") for at in (1, 16)]
    return df.select(row_digest(df).alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *sums).alias("digest"))


def save_archive(folder: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Write every table as Parquet, then a manifest (name, rows, digest, schema, format): without it an archive isn't one."""
    spark = next(iter(tables.values())).sparkSession
    told = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
        saved = spark.read.parquet(f"{folder}/{name}")
        one = digest(saved).select(F.lit(name).alias("name"), "rows", "digest", F.lit(schema_of(saved)).alias("schema"), F.lit(FORMAT).alias("format"))
        told = one if told is None else told.unionByName(one)
    told.write.mode("errorifexists").parquet(f"{folder}/_manifest.parquet")
    return spark.read.parquet(f"{folder}/_manifest.parquet")


def load_archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an archive; raises if one doesn't hold what the manifest says."""
    out = {}
    for r in spark.read.parquet(f"{folder}/_manifest.parquet").collect():  # a row for each table
        if r.format != FORMAT:
            raise ValueError(f"archive format {r.format}")
        out[r["name"]] = spark.read.parquet(f"{folder}/{r['name']}")
        now = digest(out[r["name"]]).first()
        if (now.rows, now.digest, schema_of(out[r["name"]])) != (r.rows, r.digest, r.schema):
            raise ValueError(f"{r['name']} is not what was saved")
    return out


def replay(log: DataFrame, key: list[str], order: list[str], removed: Column) -> DataFrame:
    """The state that a log of puts and removals leaves: the last entry of each key, unless it removes."""
    last = log.withColumn("_removed", removed).groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("last"))
    return last.where("NOT last._removed").select("last.*").drop("_removed")


def maker_of(make: object) -> str:
    """Names what makes a result: its module, name and code, and what it closes over where that can be told."""
    kind = make if hasattr(make, "__code__") else type(make)
    code = getattr(kind, "__code__", None) or getattr(getattr(kind, "__call__", None), "__code__", None)
    held = [repr(c.cell_contents) for c in getattr(kind, "__closure__", None) or () if isinstance(c.cell_contents, (str, int, float, bool, tuple, type(None)))]
    return json.dumps([kind.__module__, kind.__qualname__, _of_code(code), held])


def _of_code(code) -> str:  # noqa: ANN001
    if code is None:
        return ""
    inner = [_of_code(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts]
    return hashlib.sha256(json.dumps([code.co_code.hex(), list(code.co_names), inner]).encode()).hexdigest()


def identity(config: object, *inputs: DataFrame, make: object = None) -> str:
    """Names a result: SHA-256 of the configuration, of what makes it, and of schema, rows and digest of what it is made from."""
    seen = [[schema_of(df), *(lambda r: (r.rows, r.digest))(digest(df).first())] for df in inputs]
    return hashlib.sha256(json.dumps([FORMAT, config, None if make is None else maker_of(make), seen], sort_keys=True).encode()).hexdigest()


def kept(config: object, make, *inputs: DataFrame) -> DataFrame:  # noqa: ANN001
    """The result under its identity in the shared folder; made and written there only if it isn't there yet.

    It is written aside and renamed when it is whole: of two writers at once the second finds the first one's result.
    """
    spark = inputs[0].sparkSession
    path = f"{shared_folder(spark)}/kept/{identity(config, *inputs, make=make)}"
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at(f"{path}/_SUCCESS")):
        aside = f"{path}-{uuid.uuid4().hex}"
        make(*inputs).write.parquet(aside)
        if files.exists(at(f"{path}/_SUCCESS")) or not files.rename(at(aside), at(path)):
            files.delete(at(aside), True)
    return spark.read.parquet(path)
