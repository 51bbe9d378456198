"""Evidence that a name is the scanned project's own, and joins with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions import names
from tessel.functions.json import parsed, text_value
from tessel.operators.manifests import NPM_SECTIONS, of_sections

# Schemes of specifiers that name a package of the project itself.
OWN_SCHEMES = ("workspace", "file", "link", "portal")
COMMENTS = r'("(?:[^"\\]++|\\.)*+")|//[^\n]*|(?s:/\*.*?(?:\*/|\z))'


def without_comments(content):
    """JSON with comments as JSON: strings stay as they are."""
    return F.regexp_replace(content, COMMENTS, "$1")


def internal_evidence(files: DataFrame) -> DataFrame:
    """Distinct (``scan_id``, ``kind`` exact or prefix, ``value``) of a scan's tsconfig and package files.

    Each of these files is read once.
    """
    base = names.basename(F.col("path"))
    is_config = F.lower(base).startswith("tsconfig") & F.lower(base).endswith(".json")
    own = files.filter(is_config | (base == "package.json")).withColumn("_config", is_config)
    docs = parsed(own.withColumn("content", F.when(F.col("_config"), without_comments(F.col("content"))).otherwise(F.col("content"))))
    item = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    exact, json = F.lit("exact"), F.col("_json")
    keys = F.map_keys(F.try_variant_get(json, "$.compilerOptions.paths", "map<string,variant>"))
    aliases = F.transform(keys, lambda k: item(F.when(k.endswith("/*"), F.lit("prefix")).otherwise(exact), F.when(k.endswith("/*"), k.substr(F.lit(1), F.char_length(k) - 1)).otherwise(k)))
    linked = of_sections(json, NPM_SECTIONS, lambda e: F.when(text_value(e["value"]).contains(":") & F.substring_index(text_value(e["value"]), ":", 1).isin(*OWN_SCHEMES), e["key"]))
    name = F.filter(F.array(text_value(F.try_variant_get(json, "$.name", "variant"))), lambda x: x != "")
    declared = F.concat(F.transform(name, lambda x: item(exact, x)), F.transform(linked, lambda x: item(exact, x["pkg"])))
    return docs.select("scan_id", F.explode(F.when(F.col("_config"), aliases).otherwise(declared)).alias("_x")).select("scan_id", "_x.kind", "_x.value").distinct()


def _by_scan(evidence: DataFrame) -> DataFrame:
    """One row for each scan: its prefixes, the scopes that its evidence is about, and ``_some``."""
    value = F.col("value")
    scope = F.when(value.startswith("@") & value.contains("/"), F.concat(F.substring_index(value, "/", 1), F.lit("/")))
    return evidence.groupBy("scan_id").agg(F.collect_set(F.when(F.col("kind") == "prefix", value)).alias("_prefixes"), F.collect_set(scope).alias("_scopes"), F.lit(True).alias("_some"))


def _without_exact(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    exact = evidence.filter("kind = 'exact'").select("scan_id", F.col("value").alias("pkg"), F.lit("npm").alias("ecosystem"))
    return refs.join(exact, ["scan_id", "pkg", "ecosystem"], "left_anti")


def apply_evidence(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """``refs`` without npm names that the scan's evidence has, exactly or by a prefix, and with ``speaks``.

    ``speaks`` tells whether any evidence of the scan is about the name's ``@scope/``; for a name without a
    scope any evidence counts.  Exact names are an equality join.  A scan's prefixes and scopes, the few keys
    of its configuration, come along as arrays.
    """
    pkg = F.col("pkg")
    both = _without_exact(refs, evidence).join(_by_scan(evidence), "scan_id", "left")
    own = F.exists("_prefixes", lambda p: F.startswith(pkg, p) | (F.concat(pkg, F.lit("/")) == p))
    both = both.filter((F.col("ecosystem") != "npm") | ~F.coalesce(own, F.lit(False)))
    scope = F.concat(F.substring_index(pkg, "/", 1), F.lit("/"))
    speaks = F.when(pkg.startswith("@"), F.coalesce(F.array_contains("_scopes", scope), F.lit(False))).otherwise(F.coalesce("_some", F.lit(False)))
    return both.withColumn("speaks", speaks).drop("_prefixes", "_scopes", "_some")


def without_internal(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """``apply_evidence`` without ``speaks``."""
    return apply_evidence(refs, evidence).drop("speaks")


def with_scope_evidence(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """``refs`` with ``speaks`` as in ``apply_evidence``, all of them."""
    pkg = F.col("pkg")
    scope = F.concat(F.substring_index(pkg, "/", 1), F.lit("/"))
    both = refs.join(_by_scan(evidence), "scan_id", "left")
    speaks = F.when(pkg.startswith("@"), F.coalesce(F.array_contains("_scopes", scope), F.lit(False))).otherwise(F.coalesce("_some", F.lit(False)))
    return both.withColumn("speaks", speaks).drop("_prefixes", "_scopes", "_some")
