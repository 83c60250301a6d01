"""Many batches of differing schema as one DataFrame of a declared one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared order: cast, nulls where missing; others are dropped."""
    if df.schema == schema:
        return df
    there = set(df.columns)
    return df.select(*((F.col(f"`{f.name}`") if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def dfs_to_lazy_df(dfs: Iterable[DataFrame], schema: T.StructType | str, spark: SparkSession | None = None) -> DataFrame:
    """The batches as one lazy DataFrame. The iterable is gone through once, here, so the result can be used again and
    again. Filters, columns and limits reach every batch's own source. A value that doesn't cast is an error."""
    schema = _schema(schema)
    batches = [aligned(df, schema) for df in dfs]
    if not batches:
        spark = spark or SparkSession.getActiveSession()
        if spark is None:
            raise ValueError("no batches and no session")
        return spark.createDataFrame([], schema)
    return _balanced(batches)


def _balanced(batches: list[DataFrame]) -> DataFrame:
    """A union tree of logarithmic depth."""
    while len(batches) > 1:
        batches = [reduce(DataFrame.unionByName, batches[i : i + 16]) for i in range(0, len(batches), 16)]
    return batches[0]


class _Piece(InputPartition):
    def __init__(self, at: int):
        super().__init__(at)


def _table(batch: Any) -> pa.Table:
    if isinstance(batch, pa.RecordBatch):
        return pa.Table.from_batches([batch])
    return batch if isinstance(batch, pa.Table) else pa.Table.from_pandas(batch, preserve_index=False)


_COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal, StringStartsWith: pc.starts_with, StringEndsWith: pc.ends_with, StringContains: pc.match_substring}


def _mask(table: pa.Table, asked: Any) -> Any:
    """Which rows of a table a pushed filter keeps; null where it can't tell, as SQL has it."""
    if isinstance(asked, Not):
        return pc.invert(_mask(table, asked.child))
    column = table.column(asked.attribute[0])
    if isinstance(asked, IsNull):
        return column.is_null()
    if isinstance(asked, IsNotNull):
        return column.is_valid()
    if isinstance(asked, In):
        return pc.if_else(column.is_valid(), pc.is_in(column, pa.array(asked.value, column.type)), None)
    return _COMPARED[type(asked)](column, asked.value)


def _understood(asked: Any, schema: T.StructType) -> bool:
    """Whether _mask() means by a filter what Spark does: comparisons of whole numbers, strings and booleans, and nulls."""
    if isinstance(asked, Not):
        return _understood(asked.child, schema)
    if type(asked) not in (*_COMPARED, In, IsNull, IsNotNull) or len(asked.attribute) != 1:
        return False
    if isinstance(asked, (IsNull, IsNotNull)):
        return True
    values = asked.value if isinstance(asked, In) else [asked.value]
    return isinstance(schema[asked.attribute[0]].dataType, (T.IntegralType, T.StringType, T.BooleanType)) and all(isinstance(v, (int, str, bool)) for v in values)


def batch_source(spark: SparkSession, makers: list[Callable[[], Iterable[Any]]], schema: T.StructType | str, batch_size: int | None = None, name: str = "nestwright_batches", columns: list[str] | None = None) -> DataFrame:
    """A source of batches that are made on the executors: each maker is a partition and yields Arrow tables, record
    batches or pandas frames, which never meet in one place. `batch_size` cuts larger batches, and joins none. No makers
    give no rows.

    Filters on whole numbers, strings, booleans and nulls are applied to a batch before it leaves its worker, where the
    session has spark.sql.python.filterPushdown.enabled, then and when the query runs. Spark doesn't tell such a source which columns are wanted:
    `columns` names those of the schema that are made."""
    if batch_size is not None and batch_size <= 0:
        raise ValueError("batch_size must be positive")
    declared = _schema(schema)
    if columns is not None:
        declared = T.StructType([declared[c] for c in columns])
    if not makers:
        return spark.createDataFrame([], declared)
    arrow = to_arrow_schema(declared)

    class Reader(DataSourceReader):
        asked: list = []

        def partitions(self) -> list[InputPartition]:
            return [_Piece(i) for i in range(len(makers))]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            for batch in makers[partition.value]():
                table = _table(batch)
                own = [table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in arrow]
                table = pa.Table.from_arrays(own, schema=arrow)
                for f in self.asked:
                    table = table.filter(_mask(table, f))
                yield from table.to_batches(batch_size)

    class Filtering(Reader):
        def pushFilters(self, filters: list) -> Iterable[Any]:
            self.asked = [f for f in filters if _understood(f, declared)]
            return [f for f in filters if not _understood(f, declared)]

    # Spark takes a reader that filters for an error where the setting is off.
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return declared

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Filtering() if pushes else Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
