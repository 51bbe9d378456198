"""Files as rows of lines.

Files have ``scan_id``, ``file_ord`` (their place in the scan), ``path`` and ``content``.  A scan is what one
call checks; every distinct, budget and verdict is one scan's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import lines

FILE = ["scan_id", "file_ord", "path"]
#: The place of a block's end that the file doesn't have.
NO_END = 1 << 30


def explode_lines(files: DataFrame) -> DataFrame:
    """One row for each line, with ``line`` from 1 and ``text``; a null content has none."""
    return files.select(*FILE, F.posexplode(lines(F.col("content"))).alias("_at", "text")).select(*FILE, (F.col("_at") + 1).alias("line"), "text")


def marks(parts: Column, opens: Callable[[Column], Column], closes: Callable[[Column], Column]) -> Column:
    """The lines of a file (an array) that open or close a block: (``at`` from 0, ``opens``)."""
    each = F.transform(parts, lambda x, i: F.struct(i.alias("at"), opens(x).alias("opens"), closes(x).alias("closes")))
    return F.transform(F.filter(each, lambda m: m["opens"] | m["closes"]), lambda m: F.struct(m["at"].alias("at"), m["opens"].alias("opens")))


def blocks(found: Column) -> Column:
    """Of ``marks`` the blocks (``low``, ``high``): from a line that opens one to the next that closes one."""
    end = lambda m: F.array_min(F.transform(F.filter(found, lambda n: ~n["opens"] & (n["at"] > m["at"])), lambda n: n["at"]))
    return F.transform(F.filter(found, lambda m: m["opens"]), lambda m: F.struct(m["at"].alias("low"), F.coalesce(end(m), F.lit(NO_END)).alias("high")))


def inside(at: Column, found: Column) -> Column:
    """Whether a line, by its place from 0, stands between the two lines of one of ``blocks``."""
    return F.coalesce(F.exists(found, lambda b: (b["low"] < at) & (at < b["high"])), F.lit(False))
