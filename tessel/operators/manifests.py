"""Dependencies that manifests declare, and manifests that can't be read.

A manifest is one row from beginning to end: its sections, blocks and replacements are arrays of that row, so no
line is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import names
from tessel.functions.json import parsed, text_value
from tessel.functions.text import group, held, lines, trimmed
from tessel.operators.imports import CLOSES, REF
from tessel.operators.lines import FILE, blocks, inside, marks

NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
COMPOSER_SECTIONS = ("require", "require-dev")
#: Kinds of manifests that are JSON, and the ecosystem of each kind.
JSON_KINDS = ("package.json", "composer")
ECOSYSTEM = {"package.json": "npm", "composer": "composer", "requirements": "pypi", "gemfile": "gems", "cargo": "crates", "gomod": "go"}


def entries(json: Column, section: str) -> Column:
    """Entries (``key``, ``value`` as variant) of an object's section, and of an array by place; null for others."""
    value = F.try_variant_get(json, f"$['{section}']", "variant")
    places = F.try_variant_get(value, "$", "array<variant>")
    by_place = F.transform(places, lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
    return F.coalesce(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), by_place)


def of_sections(json: Column, sections: tuple[str, ...], item: Callable[[Column], Column]) -> Column:
    """What ``item`` makes of the entries of all sections, in the order of section and key, without nulls.

    ``item`` gives a string for an entry; the result has ``key`` and ``pkg``.
    """
    parts = []
    for name in sections:
        made = F.transform(entries(json, name), lambda e: F.struct(e["key"].alias("key"), item(e).alias("pkg")))
        parts.append(F.coalesce(F.array_sort(F.filter(made, lambda x: x["pkg"].isNotNull() & (x["pkg"] != ""))), F.array().cast("array<struct<key:string,pkg:string>>")))
    return F.concat(*parts)


def declaration_line(parts: Column, name: Column) -> Column:
    """The first line that has the name in quotes, or 1."""
    needle = F.concat(F.lit('"'), name, F.lit('"'))
    at = F.array_position(F.transform(parts, lambda x: F.contains(x, needle)), True)
    return F.greatest(at, F.lit(1)).cast("int")


def _item(line: Column, seg: Column, pkg: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), seg.cast("int").alias("seg"), pkg.alias("pkg"))


def _given(items: Column) -> Column:
    return F.filter(items, lambda x: x["pkg"].isNotNull())


def json_items(json: Column, sections: tuple[str, ...], item: Callable[[Column], Column], parts: Column) -> Column:
    """The references of a JSON manifest."""
    return F.transform(of_sections(json, sections, item), lambda x, i: _item(declaration_line(parts, x["key"]), i + 1, x["pkg"]))


def line_items(parts: Column, target: Callable[[Column], Column]) -> Column:
    """The references of a manifest whose lines are independent."""
    return _given(F.transform(parts, lambda x, i: _item(i + 1, F.lit(0), target(x))))


def cargo_sections(parts: Column) -> Column:
    """The headers of a Cargo.toml: (``at`` from 0, ``name``)."""
    return F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("at"), names.cargo_header(x).alias("name"))), lambda h: h["name"].isNotNull())


def cargo_items(parts: Column, heads: Column) -> Column:
    """Entries of dependency sections, and ``[dependencies.NAME]`` tables with their renames."""

    def of_section(h: Column, k: Column) -> Column:
        end = F.coalesce(F.get(heads, k + 1)["at"], F.size(parts))
        body = F.slice(parts, h["at"] + 2, end - h["at"] - 1)
        plain = _given(F.transform(body, lambda x, i: _item(h["at"] + i + 2, F.lit(0), names.cargo_dependency(x))))
        name = names.cargo_table(h["name"])
        key = lambda x: F.when(x.contains("="), trimmed(F.substring_index(x, "=", 1)))
        renames = F.filter(F.transform(body, lambda x: F.when(key(x) == "package", group(x, r'^[^=]*=\s*"([^"]+)"'))), lambda x: x.isNotNull())
        local = F.exists(body, lambda x: F.coalesce(key(x).isin("path", "git"), F.lit(False)))
        table = F.array(_item(h["at"] + 1, F.lit(0), F.coalesce(F.get(renames, F.size(renames) - 1), name)))
        return F.when(names.is_cargo_section(h["name"]), plain).when(name.isNotNull() & ~local, table)

    return F.flatten(F.filter(F.transform(heads, of_section), lambda x: x.isNotNull()))


def go_replaced(parts: Column, within: Column) -> Column:
    """Modules of a go.mod that a local path replaces; ``within`` are its blocks of replacements."""

    def replaced(x: Column, i: Column) -> Column:
        module, target = names.go_replacement(x)
        local = target.startswith("./") | target.startswith("../") | target.startswith("/")
        return F.when((inside(i, within) | x.rlike(r"^\s*replace\s")) & local, module)

    return F.filter(F.transform(parts, replaced), lambda x: x.isNotNull())


def go_mod_items(parts: Column, within: Column, replaced: Column) -> Column:
    """Required modules, without those that a local path replaces; ``within`` are the blocks of requirements."""
    required = F.transform(parts, lambda x, i: _item(i + 1, F.lit(0), names.go_requirement(x, inside(i, within))))
    return F.filter(_given(required), lambda x: ~F.coalesce(F.array_contains(replaced, x["pkg"]), F.lit(False)))


def manifest_refs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All references of manifests, and one row (``FILE``) for each JSON manifest that isn't JSON.

    Each manifest is read once for its references.
    """
    kind = F.col("_kind")
    own = files.withColumn("_kind", names.manifest_kind(F.col("path"))).filter(kind.isNotNull() & F.col("content").isNotNull())
    rows = held(parsed(own, kind.isin(*JSON_KINDS)), "_lines", lines(F.col("content"))).select(*FILE, "_kind", "_json", "_lines")
    parts, found = F.col("_lines"), F.col("_json")
    marked = lambda opens: marks(parts, lambda x: x.rlike(opens), lambda x: x.rlike(CLOSES))
    rows = held(rows, "_heads", F.when(kind == "cargo", cargo_sections(parts)))
    for name, opens in (("_require", r"^\s*require\s*\("), ("_replace", r"^\s*replace\s*\(")):
        rows = held(rows, f"{name}_marks", F.when(kind == "gomod", marked(opens)))
        rows = held(rows, f"{name}_blocks", F.when(kind == "gomod", blocks(F.col(f"{name}_marks")))).drop(f"{name}_marks")
    rows = held(rows, "_replaced", F.when(kind == "gomod", go_replaced(parts, F.col("_replace_blocks"))))
    items = (
        F.when(kind == "package.json", json_items(found, NPM_SECTIONS, lambda e: F.when(text_value(e["value"]).isNotNull(), names.npm_dependency_target(e["key"], text_value(e["value"]))), parts))
        .when(kind == "composer", json_items(found, COMPOSER_SECTIONS, lambda e: F.when(names.is_composer_package(e["key"]), e["key"]), parts))
        .when(kind == "requirements", line_items(parts, names.requirement_of_line)).when(kind == "gemfile", line_items(parts, names.gem_of_line))
        .when(kind == "cargo", cargo_items(parts, F.col("_heads"))).when(kind == "gomod", go_mod_items(parts, F.col("_require_blocks"), F.col("_replaced")))
    )
    ecosystem = F.lit(None).cast("string")
    for k, name in ECOSYSTEM.items():
        ecosystem = F.when(kind == k, F.lit(name)).otherwise(ecosystem)
    refs = rows.select(*FILE, ecosystem.alias("ecosystem"), F.explode(items).alias("_x")).select(*FILE, "_x.line", "_x.seg", "_x.pkg", "ecosystem").select(REF)
    errors = parsed(own.filter(kind.isin(*JSON_KINDS))).filter("_json IS NULL").select(FILE)
    return refs, errors
