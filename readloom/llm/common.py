"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.tables import discard, materialise, new_path, partitions, shared_dir, spread

__all__ = ["ascii_lower", "discard", "id_fold", "materialise", "new_path", "partitions", "shared_dir", "spread"]

#: Words are separated by these characters and nothing else.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_fold(key: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n
