"""Which documents a model may learn from."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the key as text falls in the part set aside; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))
