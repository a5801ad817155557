"""What the operators of this subpackage share: shared storage and column access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import materialize, shared_dir, shared_path

__all__ = ["materialize", "shared_dir", "shared_path"]

#: The white space of the text contracts, as a set of characters.
SPACES = " \t\n\x0b\x0c\r"
#: One word: a run of anything else. The same pattern in Java's and Python's syntax.
WORD = r"[^\x20\x09-\x0D]+"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_kept: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What an operator keeps in a Python worker between batches and tasks. A worker that turns to another operator
    drops what it kept for the one before, so that a run of several operators needs no more memory than one."""
    for name in list(_kept):
        if name != operator:
            del _kept[name]
    return _kept.setdefault(operator, {})


def small(written: DataFrame, rows: int = 400_000) -> DataFrame:
    """A written table, marked for broadcast if it has ``rows`` rows at most; else as it is, for a join by shuffle."""
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with null texts as empty; other columns go, so their names can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else. ``lower`` does just that where all is ASCII, and is faster."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, A_Z, a_z)).otherwise(F.lower(c))


def wide_hash(c: Column) -> tuple[Column, Column]:
    """128 bits of xxHash: XXH64 of the same value under two different seeds."""
    return F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(2), c)


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")
