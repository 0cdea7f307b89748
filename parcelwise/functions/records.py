"""Values out of loosely structured records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nested_get(record: Column, path: str, kind: str, default: Column) -> Column:
    """The value at a path (like $.a.b) of a variant: the default where the field or one above it is missing, null where it is there and null.

    A value that can't be cast to kind is null, too.
    """
    raw = F.try_variant_get(record, path, "variant")
    return F.when(raw.isNull(), default).otherwise(F.try_variant_get(record, path, kind))
