"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the scanned languages' own tools see it (Unicode's, and the byte order mark).
BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, or null if there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once, however often later steps and filters name it.

    It is the output of a generator, into which the optimiser doesn't fold what comes after.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def where_found(rows: DataFrame, name: str, value: Column, test=None) -> DataFrame:
    """As ``held``, with the rows alone where the value isn't null and passes the test (a function of it)."""
    good = lambda x: x.isNotNull() if test is None else x.isNotNull() & test(x)
    return rows.select("*", F.explode(F.filter(F.array(value), good)).alias(name))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def lines(content: Column) -> Column:
    """Lines of a text, split at line feeds alone; a last empty line is one."""
    return F.split(content, "\n", -1)


def entropy(value: Column) -> Column:
    """Shannon's entropy of a string in bits a character; 0 for an empty one."""
    n = F.char_length(value).cast("double")

    def add(total: Column, c: Column) -> Column:
        p = (n - F.char_length(F.replace(value, c, F.lit("")))) / n
        return total - p * F.log2(p)

    return F.aggregate(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), F.lit(0.0), add)


def percent_encoded(text: Column) -> Column:
    """Percent-encoding of a URL's part that leaves letters, digits and ``- _ . ~ ! ( ) ' *``."""
    out = F.url_encode(text)
    for code, char in (("\\+", "%20"), ("%7E", "~"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%27", "'")):
        out = F.regexp_replace(out, code, char)
    return out
