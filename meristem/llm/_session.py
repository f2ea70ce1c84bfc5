"""What these operators need from the session besides meristem.session."""

from __future__ import annotations

from pyspark.sql.types import StructType

from ..session import cut, shared_dir  # noqa: F401


def extended(schema: StructType, ddl: str) -> StructType:
    """The schema with fields given as DDL after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
