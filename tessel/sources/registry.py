"""Registry answers as a table.

The engine makes no requests: answers are a table of ``ecosystem``, ``name``, ``status`` (of HTTP) and
``body`` (JSON text).  A name without a row, a status other than 200 and those for an absent package, and a
body that isn't JSON mean that the registry was not reached: existence is unknown, not denied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import names
from tessel.functions.risk import NEW_DAYS

RESULT = ["exists", "unreachable", "is_new", "published_at", "has_install_scripts", "has_provenance", "is_deprecated", "has_repository"]
#: A request's address by ecosystem: what a client that fills the table asks for.
URLS = {
    "npm": lambda n: F.concat(F.lit("https://registry.npmjs.org/"), names.npm_url_name(n)), "pypi": lambda n: F.concat(F.lit("https://pypi.org/pypi/"), names.percent_encoded(n), F.lit("/json")),
    "crates": lambda n: F.concat(F.lit("https://crates.io/api/v1/crates/"), names.percent_encoded(n)), "gems": lambda n: F.concat(F.lit("https://rubygems.org/api/v1/versions/"), names.percent_encoded(n), F.lit(".json")),
    "composer": lambda n: F.concat(F.lit("https://packagist.org/packages/"), names.encoded_path(n), F.lit(".json")), "go": lambda n: F.concat(F.lit("https://proxy.golang.org/"), names.encoded_path(names.go_proxy_escaped(n)), F.lit("/@latest")),
}


def request_url(ecosystem: Column, name: Column) -> Column:
    out = F.lit(None).cast("string")
    for eco, url in URLS.items():
        out = F.when(ecosystem == eco, url(name)).otherwise(out)
    return out


def _text(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def _truthy(v: Column) -> Column:
    """Whether a variant is there and is not null, false, zero or an empty string."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(v.isNotNull() & (kind != "VOID") & ~F.coalesce(text.isin("", "false", "0"), F.lit(False)), F.lit(False))


def parse_answers(answers: DataFrame, as_of: str) -> DataFrame:
    """``ecosystem``, ``name`` and the columns of ``RESULT`` for each answer.

    ``as_of`` is the moment (UTC) by which a package is new.  Times without a zone are taken as UTC: sessions
    are expected in that zone.
    """
    v = F.try_parse_json("body")
    rows = answers.withColumn("_v", v)
    v = F.col("_v")
    versions = F.try_variant_get(v, "$.versions", "map<string,variant>")
    created = _text(v, "$.time.created")
    latest = F.element_at(versions, _text(v, "$['dist-tags'].latest"))
    releases = F.flatten(F.map_values(F.try_variant_get(v, "$.releases", "map<string,array<variant>>")))
    gems = F.try_variant_get(v, "$", "array<variant>")
    least = lambda items, path: F.array_min(F.filter(F.transform(items, lambda x: _text(x, path)), lambda x: x.isNotNull()))
    eco, ok = F.col("ecosystem"), F.col("status") == 200
    gone = (F.col("status") == 404) | ((eco == "go") & (F.col("status") == 410))
    absent = gone | (ok & (eco == "npm") & (F.coalesce(F.size(versions), F.lit(0)) <= 0) & created.isNotNull()) | (ok & (eco == "gems") & v.isNotNull() & (F.coalesce(F.size(gems), F.lit(0)) <= 0))
    absent = F.coalesce(absent, F.lit(False))
    unreachable = ~absent & ~F.coalesce(ok & v.isNotNull(), F.lit(False))
    published = (
        F.when(eco == "npm", created).when(eco == "pypi", least(releases, "$.upload_time")).when(eco == "crates", _text(v, "$.crate.created_at"))
        .when(eco == "gems", least(gems, "$.created_at")).when(eco == "composer", _text(v, "$.package.time"))
    )
    there = ~absent & ~unreachable
    published = F.when(there, F.try_to_timestamp(published))
    npm = there & (eco == "npm")
    scripts = [F.try_variant_get(latest, f"$.scripts.{x}", "variant") for x in ("preinstall", "install", "postinstall")]
    return rows.select(
        "ecosystem", "name", ~absent, unreachable.alias("unreachable"), F.coalesce(age_ms(published, as_of) < NEW_DAYS * 86_400_000, F.lit(False)).alias("is_new"), published.alias("published_at"),
        F.when(npm, _truthy(scripts[0]) | _truthy(scripts[1]) | _truthy(scripts[2])).alias("has_install_scripts"), F.when(npm, _truthy(F.try_variant_get(latest, "$.dist.attestations", "variant"))).alias("has_provenance"),
        F.when(npm, F.coalesce((F.schema_of_variant(F.try_variant_get(latest, "$.deprecated", "variant")) == "STRING") & _text(latest, "$.deprecated").isNotNull(), F.lit(False))).alias("is_deprecated"),
        F.when(npm, _truthy(F.try_variant_get(v, "$.repository.url", "variant"))).alias("has_repository"),
    ).toDF("ecosystem", "name", *RESULT)


def age_ms(published: Column, as_of: str) -> Column:
    return F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis(published)


def age_days(published: Column, as_of: str) -> Column:
    """Whole days of 24 hours."""
    return F.floor(age_ms(published, as_of) / 86_400_000).cast("int")


def with_registry(refs: DataFrame, results: DataFrame) -> DataFrame:
    """``refs`` with the registry's result; one without an answer is there as far as is known, unreachable."""
    side = results.withColumnRenamed("name", "pkg").dropDuplicates(["ecosystem", "pkg"])
    return refs.join(side, ["ecosystem", "pkg"], "left").withColumn("unreachable", F.coalesce("unreachable", F.lit(True))).withColumn("exists", F.coalesce("exists", F.lit(True))).withColumn("is_new", F.coalesce("is_new", F.lit(False)))
