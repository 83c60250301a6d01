"""Typed schemas: Python declarations of Spark columns, and records to and from DataFrames."""

from nestwright.typed.build import Builder, get_builder, model
from nestwright.typed.context import Context, ContextFieldProtocol
from nestwright.typed.dtypes import F32, F64, I8, I16, I32, I64, U8, U16, U32, U64, DurationMs, DurationNs, DurationUs, TimestampMs, TimestampNs, TimestampUs
from nestwright.typed.schema import Column, FlatDict, FlatListStruct, FlatStruct, FlatTuple, ListStruct, Schema, Struct

__all__ = [
    "F32", "F64", "I8", "I16", "I32", "I64", "U8", "U16", "U32", "U64", "Builder", "Column", "Context", "ContextFieldProtocol", "DurationMs", "DurationNs", "DurationUs",
    "FlatDict", "FlatListStruct", "FlatStruct", "FlatTuple", "ListStruct", "Schema", "Struct", "TimestampMs", "TimestampNs", "TimestampUs", "get_builder", "model",
]
