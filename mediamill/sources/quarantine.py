"""Rows of JSON text sorted out: those that can be read as fields, and a dead-letter table of the others, each with its text and a reason."""

from __future__ import annotations

import errno
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

#: What is wrong with a row, or with a file.
EMPTY, UNREADABLE, NOT_OBJECT, MISSING, WRONG_TYPE = "empty", "unreadable", "notAnObject", "missing", "wrongType"
UNSUPPORTED, FILE_MOVED, FILE_NOT_ALLOWED, READ_FAILED = "unsupported", "fileMoved", "fileNotAllowed", "readFailed"


class Sorted(NamedTuple):
    good: DataFrame
    dead: DataFrame


def reason(text: Column, fields: dict[str, str], required: list[str]) -> Column:
    """Why a text can't be read as an object with these fields (name to SQL type); null if it can.

    In this order: empty (null or blank), unreadable, notAnObject, missing:<field> of the first required field that isn't there or is null,
    wrongType:<field> of the first field that isn't null and can't be read as its type.
    """
    v = F.try_parse_json(text)
    member = lambda name: F.try_variant_get(v, f"$['{name}']", "variant")
    nothing = lambda name: member(name).isNull() | F.is_variant_null(member(name))
    why = F.when(text.isNull() | (F.trim(text) == ""), EMPTY).when(v.isNull(), UNREADABLE).when(F.try_variant_get(v, "$", "map<string,variant>").isNull(), NOT_OBJECT)
    for name in required:
        why = why.when(nothing(name), f"{MISSING}:{name}")
    for name, kind in fields.items():
        why = why.when(~nothing(name) & F.try_variant_get(v, f"$['{name}']", kind).isNull(), f"{WRONG_TYPE}:{name}")
    return why


def sort_out(rows: DataFrame, text_col: str, fields: dict[str, str], required: list[str] | None = None) -> Sorted:
    """``rows`` in two: good ones with a column for each field in place of the text, and dead ones as they came, with ``reason``.

    Every row is in exactly one of the two. A field that isn't required may be absent: null. The parse is a column expression, so
    either side is one narrow pass over the input; write the dead ones with ``keep_dead`` and go on with the good ones.
    """
    why = reason(F.col(text_col), fields, required or [])
    v = F.try_parse_json(text_col)
    rest = [c for c in rows.columns if c != text_col]
    good = rows.where(why.isNull()).select(*rest, *[F.try_variant_get(v, f"$['{n}']", kind).alias(n) for n, kind in fields.items()])
    return Sorted(good, rows.withColumn("reason", why).where(F.col("reason").isNotNull()))


def keep_dead(dead: DataFrame, path: str, run: str) -> None:
    """Dead rows of a run in a folder of its own by reason, so that a run that is done again replaces its own."""
    kind = F.substring_index("reason", ":", 1)
    dead.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/run={run}")


def failure(error: BaseException) -> str:
    """What a failed read of a file means: damage or an unknown kind, a file that has gone, one that may not be read, or else that reading failed."""
    if not isinstance(error, OSError):
        return UNSUPPORTED
    return {errno.ENOENT: FILE_MOVED, errno.EACCES: FILE_NOT_ALLOWED, errno.EPERM: FILE_NOT_ALLOWED}.get(error.errno, READ_FAILED)
