"""Names in lines, paths and specifiers."""

import pytest
from pyspark.sql import functions as F

from tessel.functions import names
from tessel.functions.text import entropy, percent_encoded, trimmed


@pytest.fixture(scope="module")
def value(spark):
    """Values of a column expression for many inputs at once."""

    def run(expression, inputs):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
        return [r[1] for r in sorted(df.select("i", expression(F.col("x"))).collect())]

    return run


def check(value, expression, cases):
    assert dict(zip(cases, value(expression, list(cases)))) == cases


def test_npm_lines(value):
    check(value, names.npm_package_of_line, {
        'import x from "lodash"': "lodash", "import 'side-effect'": "side-effect", 'import y from "@scope/pkg/deep/path"': "@scope/pkg", 'import z from "pkg/deep"': "pkg", "const a = await import('dyn')": "dyn",
        'export * from "re/x"': "re", 'const r = require("cjs/x")': "cjs", 'require("@s/p")': "@s", '} from "wrapped"': "wrapped", '  from "wrapped/x"': "wrapped", 'import a from "./rel"': None, 'import a from "~/x"': None,
        'import a from "#x"': None, "import a from \"mixed'": None, 'const x = "import"': None, 'import { api } from "@/lib"': "@/lib", "": None,
    })
    check(value, lambda c: names.npm_package_of_line(c, scoped_require=True), {'require("@s/p/x")': "@s/p"})


def test_npm_names(value):
    check(value, names.is_npm_name, {"lodash": True, "@s/p": True, "@/lib": False, "node:fs": False, "fs": False, "fs/promises": False, "node_modules": False, "@s": False, "UPPER": True, "a b": False, "a\n": False})
    check(value, names.package_root, {"@s/n/x": "@s/n", "n/x": "n", "n": "n", "@s": "@s"})


def test_python_lines(value):
    check(value, names.python_package_of_line, {"import os": "os", "from a_b.c import d": "a-b", "  import x": "x", "import x\r": "x", "import 1x": None, "importx y": None, "from . import x": None, "import a;b": None})
    check(value, names.python_segments, {"import os, a as b": ["import os", "import a as b"], "from x import a, b": ["from x import a, b"], "import os, x\r": ["import os, x\r"], "x = 1": ["x = 1"]})
    check(value, names.is_python_stdlib, {"os": True, "--future--": True, "concurrent": True, "numpy": False})


def test_rust_lines(value):
    check(value, names.rust_crate_of_line, {"use serde_json::Value;": "serde_json", "pub use rand::Rng;": "rand", "extern crate foo;": "foo", "use std::io;": None, "use crate::x;": None, "// use x;": None, "let use = 1": None})


def test_go(value):
    check(value, names.go_module_root, {
        "github.com/aws/aws-sdk-go-v2/service/s3": "github.com/aws/aws-sdk-go-v2", "github.com/aws": None, "fmt": None, "net/http": None, "golang.org/x/net/html": "golang.org/x/net", "golang.org/y/z": None,
        "gopkg.in/yaml.v3": "gopkg.in/yaml.v3", "gopkg.in/a/b.v1/c": "gopkg.in/a/b.v1", "gopkg.in/a": None, "example.com/a/b": None, "GitHub.com/a/b": "GitHub.com/a/b",
    })
    check(value, lambda c: names.go_module_root(names.go_path_of_line(c, F.lit(True))), {'import "github.com/a/b"': "github.com/a/b", '  x "github.com/a/b/c"': "github.com/a/b", '"github.com/a/b" // c': None, "": None})
    check(value, lambda c: names.go_module_root(names.go_path_of_line(c, F.lit(False))), {'import _ "github.com/a/b"': "github.com/a/b", '"github.com/a/b"': None})


def test_paths(value):
    check(value, names.basename, {"a/b.c": "b.c", "a\\b": "b", "x": "x", "a/": ""})
    check(value, names.manifest_kind, {"x/package.json": "package.json", "Cargo.toml": "cargo", "go.mod": "gomod", "Gemfile": "gemfile", "composer.json": "composer", "dev-Requirements.TXT": "requirements", "requirements/x.txt": None, "gemfile": None, "": None})
    check(value, names.ecosystem_of_path, {"a.PY": "pypi", "a.mts": "npm", "a.cts": "npm", "a.rs": "crates", "a.go": "go", "a.rb": None, "a.php": None, "py": None})


def test_specifiers(value):
    one = lambda c: names.npm_dependency_target(F.lit("me"), c)
    check(value, one, {"^1": "me", "": "me", "npm:real@1": "real", "npm:@s/real@1": "@s/real", "npm:": None, "workspace:*": None, "catalog:": None, "git+ssh://x": None, "github:u/r": None, "u/r": None, "https://x": None, "link:x": None})
    check(value, names.requirement_of_line, {"flask==1": "flask", "  A_b.c[x] >= 2 # n": "A-b-c", "# x": None, "x#y": "x", "-r a": None, "./x": None, "/x": None, "a @ https://x": None, "git+https://x": None, "": None, " django": "django"})
    check(value, names.gem_of_line, {'gem "rails"': "rails", "  gem 'a', '~> 1'": "a", "gem 'a', path: 'x'": None, "gem 'a', :git => 'x'": None, "gem 'a', branch: 'x'": None, "# gem 'a'": None, "gemspec": None})
    check(value, names.cargo_dependency, {'a = "1"': "a", 'a = { path = "x" }': None, 'a = { package = "b" }': "b", "a = { version = \"1\" }": "a", "a = true": None, "a": None, 'a = "1"\r': None})
    check(value, names.is_composer_package, {"v/n": True, "PHPMailer/PHPMailer": True, "php": False, "ext-json": False, "php-64bit": False, "lib-x": False, "hhvm": False, "n": False})


def test_addresses(value):
    check(value, names.npm_url_name, {"@s/n": "@s%2Fn", "a b": "a%20b", "a~(b)!'*": "a~(b)!'*"})
    check(value, names.go_proxy_escaped, {"github.com/Azure/X": "github.com/!azure/!x", "a": "a"})
    check(value, names.encoded_path, {"a b/c?": "a%20b/c%3F"})
    check(value, percent_encoded, {"é+": "%C3%A9%2B"})
    check(value, lambda c: names.list_key(c, F.lit("crates")), {"A_b": "crates:a-b"})
    check(value, lambda c: names.list_key(c, F.lit("npm")), {"A_b": "npm:a_b"})


def test_text(value):
    check(value, trimmed, {" a \n": "a", " ﻿a b ": "a b", "": ""})
    check(value, lambda c: F.round(entropy(c), 6), {"": 0.0, "aaaa": 0.0, "ab": 1.0, "abcd": 2.0, "aab": 0.918296})


def test_quotes_and_blocks(value):
    check(value, names.npm_package_of_line, {
        "// don't import x from 'y'": "y", "import a from \"./rel\"; import('dyn')": "dyn", "x from 'a' + from \"b\"": None, "  from './a'  from \"b\"": None, "import('a') ; import b from 'c'": "c", 'const a = require("x"); import("y")': "y",
        "import('a'": None, "export { a } from 'b'": "b", "from 'x": None, "import 'a\"b'; import c from \"d\"": "d",
    })


def test_python_modules_of_all_versions(value):
    """Names that a newer Python no longer has are no packages, whatever Python runs this."""
    check(value, names.is_python_stdlib, {"distutils": True, "cgi": True, "imp": True, "asyncore": True, "telnetlib": True, "crypt": True, "lib2to3": True, "tomllib": True, "annotationlib": False, "sre-compile": True})


def test_manifest_lines(value):
    check(value, names.cargo_header, {"[a]": "a", "  [ a.b ] ": "a.b", "[[bin]]": None, "[]": None, "a = [1]": None, "[a] # x": None, "": None})
    check(value, names.is_cargo_section, {
        "dependencies": True, "dev-dependencies": True, "workspace.build-dependencies": True, "target.'cfg(unix)'.dependencies": True, "target.a.b.dev-dependencies": True, "target..dependencies": False, "target.dependencies": False, "x.dependencies": False,
        "workspace.x.dependencies": False, "dependencies.a": False, "package": False,
    })
    check(value, names.cargo_table, {"dependencies.a": "a", "workspace.dev-dependencies.a-b": "a-b", "target.x.dependencies.a": None, "dependencies": None, "dependencies.a.b": None, "workspace.a": None})
    check(value, names.cargo_dependency, {"a={git='x'}": None, "a = { x-path = 1 }": None, "a = { mypath = 1 }": "a", 'a = { version = "1", package = "b", x = "c" }': "b", 'a.b = "1"': None, 'a == "1"': None, "a =": None, "= 1": None})
    check(value, lambda c: names.go_requirement(c, F.lit(False)), {"require github.com/a/b v1.0": "github.com/a/b", " require\tx.io/y v2 // i": "x.io/y", "github.com/a/b v1": None, "require a/b v1": None, "require x.io v1": None, "require x.io/y 1": None, "require x.i/y v1": None, "require x.io//y v1": None, "require (": None})
    check(value, lambda c: names.go_requirement(c, F.lit(True)), {"\tgithub.com/a/b v1.0": "github.com/a/b", "require x.io/y v2": "x.io/y", "-x.io/y v1": None, ")": None, "": None})
    check(value, lambda c: names.go_replacement(c)[0], {"replace a/b => ../c": "a/b", "  a/b v1 => ../c": "a/b", "replace a b c => d": None, "replace a": None, "=> x": None, "": None})
    check(value, lambda c: names.go_replacement(c)[1], {"replace a/b => ../c v2": "../c", "a/b v1 => ./c": "./c", "a =>": None})
    check(value, names.gem_of_line, {"gem 'a', :x => 1, git: 'y'": None, "gem 'a', a:git:1": None, "gem 'a', widget: 1": "a", "gem \"a'": "a", "gem 'a": None, "gem'a'": None, "gem 'a b'": None, "gem 'a', 'path' => 1": "a"})
    check(value, lambda c: names.npm_dependency_target(F.lit("me"), c), {"git:x": None, "git+ssh:x": None, "git+SSH:x": "me", "x:y": "me", "file:": None, "files:x": "me"})
