"""Facts of projects: package manifests, workspaces, compiler path mappings, installed packages.

Each is a table with a few rows a project, read by the executors; nothing is held on
the driver.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.paths import glob_to_regex
from plinth.operators.tables import written
from plinth.sources.files import parse_jsonc

#: Fields of a manifest that declare a dependency; the first two must be used.
RUNTIME_FIELDS, OTHER_FIELDS = ("dependencies", "devDependencies"), ("peerDependencies", "optionalDependencies")


def folder(path: Column) -> Column:
    """The directory of a path; empty for a bare name."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def read_texts(spark: SparkSession, roots: list[str], glob: str, installed: bool = False) -> DataFrame:
    """``path, text`` of the files below ``roots`` that fit ``glob``; those in ``node_modules`` only if ``installed``, and then only those."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(list(roots))
    found = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))
    inside = F.col("path").rlike("(^|/)node_modules/")
    return found.where(inside if installed else ~inside)


def _rows(texts: DataFrame, schema: str, make: Callable[[str, object], list[tuple]]) -> DataFrame:
    """``make(path, parsed)`` over all files; what is not JSON with comments gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(texts.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    parsed = parse_jsonc(text or "")
                except (json.JSONDecodeError, RecursionError):
                    continue
                out += make(path, parsed) if isinstance(parsed, dict) else []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return texts.select("path", "text").mapInArrow(run, schema)


MANIFEST = "dir string, name string, field string, key string, value string"


def manifests(texts: DataFrame) -> DataFrame:
    """``dir, name, field, key, value`` of package manifests.

    ``field`` is one of the dependency fields (``key`` the package, ``value`` its range),
    ``entry`` (``value`` a file), ``workspace`` (``value`` a glob), or ``bin``. A row with
    field ``package`` stands for the manifest itself.
    """

    def make(path: str, m: dict) -> list[tuple]:
        at = posixpath.dirname(path)
        name = m.get("name") if isinstance(m.get("name"), str) else None
        out = [(at, name, "package", None, None)]
        for field in (*RUNTIME_FIELDS, *OTHER_FIELDS):
            if isinstance(m.get(field), dict):
                out += [(at, name, field, k, str(v)) for k, v in m[field].items()]
        binary = m.get("bin")
        out += [(at, name, "bin", None, b) for b in ([binary] if isinstance(binary, str) and binary else [str(v) for v in binary.values()] if isinstance(binary, dict) else [])]

        def files(x) -> list[str]:
            return [x] if isinstance(x, str) else [f for v in (x.values() if isinstance(x, dict) else x) for f in files(v)] if isinstance(x, (dict, list)) else []

        entries = [f for key in ("main", "module", "types", "browser", "exports", "bin") for f in files(m.get(key))]
        out += [(at, name, "entry", None, posixpath.normpath(posixpath.join(at, f))) for f in dict.fromkeys(entries)]
        spaces = m.get("workspaces")
        spaces = spaces.get("packages") if isinstance(spaces, dict) else spaces
        out += [(at, name, "workspace", None, s) for s in (spaces if isinstance(spaces, list) else []) if isinstance(s, str)]
        return out

    return _rows(texts, MANIFEST, make)


def pnpm_globs(text: str) -> list[str]:
    """The list below ``packages:`` of a workspace file; a new key ends it."""
    out, inside = [], False
    for line in text.split("\n"):
        line = line.strip()
        if line == "packages:":
            inside = True
        elif inside and line.startswith("- "):
            out += [v] if (v := re.sub(r"^['\"]|['\"]$", "", line[2:].strip())) else []
        elif inside and line and not line.startswith("#"):
            break
    return out


def workspaces(spark: SparkSession, manifest: DataFrame, pnpm: DataFrame | None = None) -> DataFrame:
    """``name, dir`` of packages that a workspace glob of a manifest above them names.

    Globs of ``pnpm`` files (``path, text``) count where the manifest beside has none.
    Of packages with one name the last directory counts.
    """
    globs = manifest.where("field = 'workspace'").select("dir", F.col("value").alias("glob"))
    if pnpm is not None:
        parse = F.udf(lambda t: pnpm_globs(t or ""), "array<string>")
        more = pnpm.select(folder(F.col("path")).alias("dir"), F.explode(parse("text")).alias("glob"))
        globs = globs.unionByName(more.join(globs.select("dir").distinct(), "dir", "left_anti"))
    regex = F.udf(lambda g: glob_to_regex(g.strip("/")), "string")
    globs = globs.select(F.col("dir").alias("root"), regex("glob").alias("pattern"))
    packages = manifest.where("field = 'package' and name is not null").select("name", "dir")
    parts = F.split("dir", "/")
    above = packages.select("name", "dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    met = above.where("root <> dir").join(globs, "root").withColumn("below", F.expr("if(root = '', dir, substring(dir, length(root) + 2))"))
    return met.where(F.expr("below rlike pattern")).groupBy("name").agg(F.max("dir").alias("dir"))


TSCONFIG = "file string, extends string, base string, pattern string, ix int, targets array<string>, types array<string>"


def tsconfigs(texts: DataFrame, max_depth: int = 32) -> DataFrame:
    """``dir, base, pattern, rank, targets``: the path mappings that hold for files below ``dir``.

    An ``extends`` is followed to files in the table; own mappings replace inherited
    ones of the same pattern, own ``baseUrl`` an inherited one. ``rank`` orders
    patterns: without a star first, then by the length before it, then as written.
    A configuration without mappings has one row with a null pattern.
    """

    def make(path: str, t: dict) -> list[tuple]:
        options = t.get("compilerOptions") if isinstance(t.get("compilerOptions"), dict) else {}
        at = posixpath.dirname(path)
        up = t.get("extends")
        up = posixpath.normpath(posixpath.join(at, up if up.endswith(".json") else up + ".json")) if isinstance(up, str) and up.startswith((".", "/")) else None
        base = options.get("baseUrl") if isinstance(options.get("baseUrl"), str) else None
        paths = options.get("paths") if isinstance(options.get("paths"), dict) else {}
        kept = [(k, v) for k, v in paths.items() if isinstance(v, list) and all(isinstance(x, str) for x in v)]
        types = [x for x in options.get("types") or [] if isinstance(x, str)] if isinstance(options.get("types"), list) else []
        return [(path, up, base, k, i, v, types) for i, (k, v) in enumerate(kept)] or [(path, up, base, None, None, None, types)]

    facts = written(_rows(texts, TSCONFIG, make), "tsconfigs")
    files = facts.select("file", "extends", "base").distinct()
    chain = written(files.select("file", F.col("file").alias("owner"), F.lit(0).alias("depth"), "extends", "base"), "tsconfig-chain")
    front, all_of = chain, chain
    for depth in range(1, max_depth):
        ups = files.select(F.col("file").alias("owner2"), F.col("extends").alias("extends2"), F.col("base").alias("base2"))
        front = front.where("extends is not null").join(ups, F.col("extends") == F.col("owner2")).select("file", F.col("owner2").alias("owner"), F.lit(depth).alias("depth"), F.col("extends2").alias("extends"), F.col("base2").alias("base"))
        front = written(front.join(all_of.select("file", "owner"), ["file", "owner"], "left_anti"), "tsconfig-chain")
        if front.isEmpty():
            break
        all_of = all_of.unionByName(front)
    base = all_of.where("base is not null").groupBy("file").agg(F.min_by("base", "depth").alias("base"))
    own = facts.where("pattern is not null").select(F.col("file").alias("owner"), "pattern", "ix", "targets")
    mapped = all_of.select("file", "owner", "depth").join(own, "owner").groupBy("file", "pattern").agg(F.min_by(F.struct("targets", "depth", "ix"), "depth").alias("m"), F.max("depth").alias("oldest"))
    star = F.instr("pattern", "*")
    order = Window.partitionBy("file").orderBy((star > 0).cast("int"), F.when(star > 0, -star).otherwise(0), F.col("oldest").desc(), F.col("m.ix"))
    ranked = mapped.select("file", "pattern", F.row_number().over(order).alias("rank"), F.col("m.targets").alias("targets"))
    whole = files.select("file").join(base, "file", "left").join(ranked, "file", "left").where(F.col("file").rlike("(^|/)tsconfig[.]json$"))
    at = folder(F.col("file"))
    return whole.select(at.alias("dir"), resolved_path(at, F.coalesce("base", F.lit("."))).alias("base"), F.col("base").isNotNull().alias("has_base"), "pattern", "rank", "targets")


def ambient_types(texts: DataFrame) -> DataFrame:
    """``dir, package`` of the packages that compiler options name as ambient types, with their ``@types`` stubs."""

    def make(path: str, t: dict) -> list[tuple]:
        options = t.get("compilerOptions") if isinstance(t.get("compilerOptions"), dict) else {}
        return [(posixpath.dirname(path), x) for x in options.get("types") or [] if isinstance(x, str)] if isinstance(options.get("types"), list) else []

    rows = _rows(texts, "dir string, spec string", make)
    parts = F.split("spec", "/")
    root = F.when(F.col("spec").startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    stub = F.concat(F.lit("@types/"), F.when(root.startswith("@"), F.regexp_replace(F.expr("substring(spec, 2)"), "^([^/]*)/([^/]*).*$", "$1__$2")).otherwise(root))
    return rows.select("dir", F.explode(F.array("spec", root, stub)).alias("package")).distinct()


def resolved_path(base: Column, path: Column) -> Column:
    """``path`` from the directory ``base``, without ``.`` and ``..``."""
    parts = F.split(F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base, path)), "/")
    step = lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/") | base.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def project_root(manifest: DataFrame, start: str, tool: str) -> str | None:
    """The nearest directory from ``start`` up whose manifest is ``tool`` or depends on it."""
    own = manifest.where((F.col("name") == tool) | ((F.col("key") == tool) & F.col("field").isin(*RUNTIME_FIELDS, *OTHER_FIELDS)))
    above = own.where((F.lit(start) == F.col("dir")) | F.lit(start).startswith(F.concat("dir", F.lit("/"))))
    return above.agg(F.max_by("dir", F.length("dir"))).first()[0]
