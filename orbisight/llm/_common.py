"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.lineage import checkpointed

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Keeps 0-9, a-z and every byte of a non-ASCII character, folds A-Z, blanks the rest.
_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).translate(_FOLD)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty and lone surrogates are replaced."""
    return text.encode("utf-8", "replace") if text else b""


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return utf8(text).translate(_WORDS).split()


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return utf8(text).translate(_FOLD).split()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names."""
    return checkpointed(df)


def by_place(docs: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ... by place, so that names that clash, in case too, are never looked up."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """The name that ``by_place`` gives to a column: the one spelled so, else the only one that differs in case."""
    if name in docs.columns:
        return f"c{docs.columns.index(name)}"
    like = [k for k, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if len(like) != 1:
        raise ValueError(f"no column {name}")
    return f"c{like[0]}"


def rows_by_arrow(df: DataFrame, schema: str, make: Callable[..., dict]) -> DataFrame:
    """Map Arrow batches of ``df`` through ``make(**columns as lists) -> columns``, keeping no state."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                made = make(**{name: part.column(k).to_pylist() for k, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)
            pa.default_memory_pool().release_unused()  # a reused worker would hold the largest batch it ever read

    return df.mapInArrow(run, schema)


def small_batches(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices, so that the Python objects of few rows exist at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def by_slices(column: pa.Array, make: Callable[[list], list]) -> list:
    """What ``make`` gives for the values of a column, a thousand at a time, so that few Python strings exist at once."""
    out: list = []
    for at in range(0, len(column), 1000):
        out += make(column.slice(at, 1000).to_pylist())
    pa.default_memory_pool().release_unused()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
