"""References to packages in source files' imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import names
from tessel.functions.text import held, lines, where_found
from tessel.operators.lines import FILE, blocks, inside, marks

REF = [*FILE, "line", "seg", "pkg", "ecosystem"]
#: Lines that open and close a block of Go imports.
GO_OPENS, CLOSES = r"^\s*import\s*\(", r"^\s*\)"


def import_refs(files: DataFrame, scoped_require: bool = False) -> DataFrame:
    """All references of imports, one for each segment of a line (an npm line has one at most).

    Names of the languages' own modules and names that no registry can have are not among them.  Ruby and
    PHP imports name paths and namespaces, not packages, and are not read.  Each file is read once and its lines
    stay where they are: the blocks of a Go file are found in its row.
    """
    source = files.withColumn("_eco", names.ecosystem_of_path(F.col("path"))).filter("_eco IS NOT NULL").select(*FILE, "_eco", "content")
    source = held(source, "_lines", lines(F.col("content"))).drop("content")
    is_go = F.col("_eco") == "go"
    source = held(source, "_marks", F.when(is_go, marks(F.col("_lines"), lambda x: x.rlike(GO_OPENS), lambda x: x.rlike(CLOSES))))
    source = held(source, "_blocks", F.when(is_go, blocks(F.col("_marks")))).drop("_marks")
    rows = source.select(*FILE, "_eco", "_blocks", F.posexplode("_lines").alias("_at", "_line"))
    rows = rows.select(*FILE, "_eco", "_at", inside(F.col("_at"), F.col("_blocks")).alias("_in"), F.posexplode(F.when(F.col("_eco") == "pypi", names.python_segments(F.col("_line"))).otherwise(F.array("_line"))).alias("seg", "_text"))
    text, eco = F.col("_text"), F.col("_eco")
    go = names.go_module_root(names.go_path_of_line(text, F.col("_in")))
    pkg = F.when(eco == "npm", names.npm_package_of_line(text, scoped_require)).when(eco == "pypi", names.python_package_of_line(text)).when(eco == "go", go).otherwise(names.rust_crate_of_line(text))
    known = lambda x: F.when(eco == "npm", names.is_npm_name(x)).when(eco == "pypi", ~names.is_python_stdlib(x)).otherwise(True)
    return where_found(rows, "pkg", pkg, known).select(*FILE, (F.col("_at") + 1).alias("line"), "seg", "pkg", eco.alias("ecosystem"))


def first_seen(refs: DataFrame) -> DataFrame:
    """Of each (scan, ecosystem, package) the earliest reference.

    The rank is limited within each task before the shuffle, so a package that all files import is a few rows.
    """
    by = Window.partitionBy("scan_id", "ecosystem", "pkg").orderBy("file_ord", "line", "seg")
    return refs.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank")
