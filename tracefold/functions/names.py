"""Names that are spelled in several ways (case, separators, surrounding blanks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(c: Column | str) -> Column:
    """Letters and digits only, lower case: 'File-Edit ' and 'file_edit' give the same; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def snake(c: Column | str) -> Column:
    """Lower case with single underscores, blanks around it cut: ' Run-Log' gives 'run_log'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s_\-]+", "_")


def run_key(c: Column | str) -> Column:
    """A run's id without case, surrounding blanks and anything from '#' on; empty gives null."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.lower(F.regexp_replace(F.regexp_replace(c, r"(?s)#.*$", ""), r"^\s+|\s+$", ""))
    return F.when(x != "", x)
