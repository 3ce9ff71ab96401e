"""Column names: normalisation and quoting."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: str) -> str:
    """Composed Unicode form without surrounding blanks, so equal-looking names are equal."""
    return unicodedata.normalize("NFC", name).strip()


def quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def col(*parts: str) -> Column:
    """A column (or struct field) reference that works for any name."""
    return F.col(quoted(*parts))
