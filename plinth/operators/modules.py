"""Module resolution and package detectors over relations, files and project facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.paths import glob_to_regex, is_builtin, mangled_types_package, package_name
from plinth.operators import graph
from plinth.operators.joins import longest_prefix
from plinth.operators.tables import written
from plinth.sources.projects import OTHER_FIELDS, RUNTIME_FIELDS, folder, resolved_path

RELATIVE = r"^\.{1,2}(/|$)"


def owner(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``path, dir``: the nearest of ``roots(dir)`` that holds each path."""
    near = longest_prefix(paths.select(F.concat(F.lit("/"), "path").alias("at")).distinct(), "at", roots.select(F.rtrim(F.concat(F.lit("/"), "dir"), F.lit("/")).alias("root")).distinct(), "root")
    return near.select(F.expr("substring(at, 2)").alias("path"), F.expr("substring(root, 2)").alias("dir"))


def resolve(relations: DataFrame, files: DataFrame, configs: DataFrame | None = None, spaces: DataFrame | None = None) -> DataFrame:
    """``relations`` with ``target`` and ``how``.

    A specifier's candidates are, in order: the file it names from the importer's
    directory; what the path mappings of the nearest configuration make of it; what
    lies below its ``baseUrl``; a package of the workspace, its index or a file in it.
    Each candidate is tried as it is, with ``.ts``, as a directory's index and with
    ``.js`` read as ``.ts``. ``how`` is ``relative``, ``alias``, ``base``, ``workspace`` or
    ``package`` (nothing of the project); ``target`` is null where a relative, mapped or
    workspace specifier has no file.
    """
    specs = relations.where("specifier is not null").select("path", "specifier").distinct()
    at = folder(F.col("path"))
    tries = [specs.where(F.col("specifier").rlike(RELATIVE)).select("path", "specifier", F.lit("relative").alias("how"), F.lit(0).alias("rank"), resolved_path(at, F.col("specifier")).alias("base"))]
    bare = specs.where(~F.col("specifier").rlike(r"^(\.|/)"))
    if configs is not None:
        near = owner(bare.select("path"), configs)
        own = bare.join(near, "path").join(configs.withColumnRenamed("base", "root"), "dir")
        star = F.instr("pattern", "*")
        head, tail = F.expr("substring(pattern, 1, instr(pattern, '*') - 1)"), F.expr("substring(pattern, instr(pattern, '*') + 1)")
        fits = F.when(star == 0, F.col("specifier") == F.col("pattern")).otherwise(F.col("specifier").startswith(head) & F.col("specifier").endswith(tail) & (F.length("specifier") >= F.length(head) + F.length(tail)))
        middle = F.when(star == 0, F.lit("")).otherwise(F.expr("substring(specifier, instr(pattern, '*'), length(specifier) - length(pattern) + 1)"))
        mapped = own.where("pattern is not null").where(fits).withColumn("best", F.min("rank").over(Window.partitionBy("path", "specifier"))).where("rank = best")
        each = mapped.select("path", "specifier", "root", middle.alias("middle"), F.posexplode("targets").alias("k", "to"))
        placed = F.when(F.instr("to", "*") > 0, F.concat(F.expr("substring(to, 1, instr(to, '*') - 1)"), F.col("middle"), F.expr("substring(to, instr(to, '*') + 1)"))).otherwise(F.col("to"))
        tries.append(each.select("path", "specifier", F.lit("alias").alias("how"), (F.col("k") + 1).alias("rank"), resolved_path(F.col("root"), placed).alias("base")))
        tries.append(own.where("has_base").select("path", "specifier", F.lit("base").alias("how"), F.lit(1 << 20).alias("rank"), resolved_path(F.col("root"), F.col("specifier")).alias("base")).distinct())
    if spaces is not None:
        packed = bare.withColumn("name", package_name(F.col("specifier"))).join(spaces, "name")
        rest = F.expr("substring(specifier, length(name) + 2)")
        inside = packed.select("path", "specifier", F.explode(F.when(rest == "", F.array("dir", F.concat("dir", F.lit("/src")))).otherwise(F.array(F.concat_ws("/", F.col("dir"), rest), F.concat_ws("/", F.col("dir"), F.lit("src"), rest)))).alias("base"))
        tries.append(inside.select("path", "specifier", F.lit("workspace").alias("how"), F.lit(1 << 21).alias("rank"), "base"))
    every = tries[0]
    for t in tries[1:]:
        every = every.unionByName(t)
    forms = F.array("base", F.concat("base", F.lit(".ts")), F.concat("base", F.lit("/index.ts")), F.regexp_replace("base", r"\.js$", ".ts"))
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    met = every.select("path", "specifier", "how", "rank", F.posexplode(forms).alias("form", "target")).join(known, "target", "left")
    # A baseUrl that has no such file says nothing about a specifier; a mapping or a workspace does.
    claim = met.where("there or how <> 'base'").groupBy("path", "specifier").agg(
        F.min(F.when(F.col("there"), F.struct("rank", "form", "target", "how"))).alias("hit"), F.min(F.struct("rank", "how")).alias("claim")
    )
    told = claim.select("path", "specifier", F.col("hit.target").alias("target"), F.coalesce("hit.how", "claim.how").alias("how"))
    joined = relations.join(told, ["path", "specifier"], "left")
    return joined.withColumn("how", F.when(F.col("specifier").isNotNull(), F.coalesce("how", F.lit("package"))))


def unresolved(resolved: DataFrame) -> DataFrame:
    """``path, specifier`` that name a file of the project which is not there."""
    return resolved.where("target is null and how in ('relative', 'alias', 'workspace')").select("path", "specifier").distinct()


def surfaces(resolved: DataFrame) -> DataFrame:
    """``path, name, from_path, from_name``: names that a module offers and where it has them from; own declarations come from themselves.

    An exported name that the module imports comes from where the import leads; a bare
    ``export *`` has the name ``*``.
    """
    own = resolved.where("type = 'exports'").select("path", F.col("local").alias("name"), F.col("imported").alias("inner"))
    imports = resolved.where("type = 'imports' and target is not null and local is not null").groupBy("path", F.col("local").alias("inner")).agg(F.min(F.struct("target", "imported")).alias("i"))
    declared = own.join(imports, ["path", "inner"], "left").select("path", "name", F.coalesce("i.target", "path").alias("from_path"), F.coalesce("i.imported", "inner").alias("from_name"))
    passed = resolved.where("type = 're-exports' and target is not null").select("path", F.coalesce("local", F.lit("*")).alias("name"), F.col("target").alias("from_path"), F.col("imported").alias("from_name"))
    return declared.unionByName(passed).distinct()


def origins(resolved: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``path, name, origin_path, origin_name`` of every name that a module offers, over chains of re-exports.

    Each round takes all open names one module further, so rounds are as many as the
    longest chain has modules; rings end where they began and give no origin. An
    ``export *`` offers the names of its module but ``default``, unless the module
    has the name otherwise.
    """
    links = written(surfaces(resolved), "surfaces")
    named = links.where("name <> '*' and from_name <> '*'")
    stars = links.where("name = '*'").select("path", "from_path").distinct()
    whole = links.where("name <> '*' and from_name = '*'").select("path", "name", F.col("from_path").alias("origin_path"), F.lit("*").alias("origin_name"))
    local = named.where("path = from_path").select("path", "name", F.col("path").alias("origin_path"), F.col("from_name").alias("origin_name"))
    known = written(local.unionByName(whole).distinct(), "origins")
    step = named.where("path <> from_path")
    own = links.where("name <> '*'").select("path", "name").distinct()
    front = known
    for _ in range(max_rounds):
        met = front.select(F.col("path").alias("from_path"), F.col("name").alias("from_name"), "origin_path", "origin_name")
        by_name = step.join(met, ["from_path", "from_name"]).select("path", "name", "origin_path", "origin_name")
        by_star = stars.join(met, "from_path").where("from_name <> 'default'").select("path", F.col("from_name").alias("name"), "origin_path", "origin_name").join(own, ["path", "name"], "left_anti")
        front = written(by_name.unionByName(by_star).distinct().join(known, ["path", "name", "origin_path", "origin_name"], "left_anti"), "origins")
        if front.isEmpty():
            return known
        known = known.unionByName(front)
    raise RuntimeError(f"chains of re-exports did not end in {max_rounds} rounds")


def dead_exports(resolved: DataFrame, entries: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``path, name`` of declared names that no other module uses, directly or over re-exports that are used.

    Files of ``entries(path)`` and what they offer, wherever it comes from, are in use.
    Held are modules that are imported or re-exported whole, and files of ``held(path)``.
    A re-export uses a name only if it is used itself. Types count like values.
    """
    found = written(origins(resolved), "origins")
    links = resolved.where("target is not null and target <> path")
    used = links.where("type = 'imports' and imported is not null and imported <> '*'").select(F.col("target").alias("path"), F.col("imported").alias("name")).distinct()
    opened = links.where("imported = '*' or type = 'dynamic'").select(F.col("target").alias("path"))
    offered = found.join(entries.select("path").union(opened).distinct(), "path", "left_semi")
    alive = found.join(used, ["path", "name"], "left_semi").unionByName(offered).select(F.col("origin_path").alias("path"), F.col("origin_name")).distinct()
    closed = opened.union(entries.select("path")).union(alive.where("origin_name = '*'").select("path"))
    if held is not None:
        closed = closed.union(held.select("path"))
    declared = found.where("path = origin_path").select("path", "name", "origin_name")
    return declared.join(alive, ["path", "origin_name"], "left_anti").join(closed.distinct(), "path", "left_anti").select("path", "name").distinct()


def nested_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path`` of files below a manifest that lies below another one: their users may lie outside (held)."""
    dirs = manifest.where("field = 'package'").select("dir").distinct()
    up = dirs.where("dir <> ''").withColumn("above", F.explode(F.expr("transform(sequence(0, size(split(dir, '/')) - 1), i -> array_join(slice(split(dir, '/'), 1, i), '/'))")))
    inner = up.join(dirs.select(F.col("dir").alias("above")), "above", "left_semi").select("dir").distinct()
    return owner(files.select("path"), dirs).join(inner, "dir", "left_semi").select("path")


def duplicate_exports(resolved: DataFrame) -> DataFrame:
    """``name, origin_path, n_modules, first_module`` of names that two modules or more export, not re-export, from one origin (A2)."""
    declared = resolved.where("type = 'exports'").select("path", F.col("local").alias("name")).distinct()
    found = origins(resolved).where("origin_name <> '*'").join(declared, ["path", "name"], "left_semi")
    many = found.groupBy("name", "origin_path", "origin_name").agg(F.count_distinct("path").alias("n_modules"), F.min("path").alias("first_module"))
    return many.where("n_modules > 1").select("name", "origin_path", "n_modules", "first_module")


def package_uses(resolved: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, dir, package`` of imports that leave the project, with the manifest that holds the importer."""
    out = resolved.where("how = 'package'").where(~is_builtin(F.col("specifier"))).select("path", package_name(F.col("specifier")).alias("package")).where("package is not null").distinct()
    return out.join(owner(out.select("path"), manifest), "path")


def unlisted_dependencies(resolved: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, package`` of imported packages that the nearest manifest declares in no field and is not itself (J2); importers without a manifest are held."""
    declared = manifest.where(F.col("field").isin(*RUNTIME_FIELDS, *OTHER_FIELDS)).select("dir", F.col("key").alias("package"))
    own = manifest.where("field = 'package' and name is not null").select("dir", F.col("name").alias("package"))
    typed = declared.where(F.col("package").startswith("@types/"))
    uses = package_uses(resolved, manifest)
    left = uses.join(declared.unionByName(own).distinct(), ["dir", "package"], "left_anti").withColumn("stub", mangled_types_package(F.col("package")))
    return left.join(typed.select("dir", F.col("package").alias("stub")).distinct(), ["dir", "stub"], "left_anti").select("path", "package")


def unused_dependencies(resolved: DataFrame, manifest: DataFrame, installed: DataFrame, ambient: DataFrame | None = None) -> DataFrame:
    """``dir, package`` of runtime and development dependencies that no file below the manifest imports.

    Held are: packages whose manifest in ``installed(dir, package, has_bin)`` has a binary
    or is not there in the manifest's directory or one above, stubs of types whose
    package is imported, and packages of ``ambient(dir, package)``.
    """
    declared = manifest.where(F.col("field").isin(*RUNTIME_FIELDS)).select("dir", F.col("key").alias("package")).distinct()
    uses = package_uses(resolved, manifest).select("dir", "package").distinct()
    stubs = uses.select("dir", mangled_types_package(F.col("package")).alias("package"))
    left = declared.join(uses.unionByName(stubs).distinct(), ["dir", "package"], "left_anti")
    if ambient is not None:
        left = left.join(ambient.select("dir", "package").distinct(), ["dir", "package"], "left_anti")
    above = left.withColumn("at", F.col("dir")).unionByName(
        left.where("dir <> ''").withColumn("at", F.explode(F.expr("transform(sequence(0, size(split(dir, '/')) - 1), i -> array_join(slice(split(dir, '/'), 1, i), '/'))")))
    )
    state = above.join(installed.select(F.col("dir").alias("at"), "package", "has_bin"), ["at", "package"]).groupBy("dir", "package").agg(F.max_by("has_bin", F.length("at")).alias("has_bin"))
    return state.where("not has_bin").select("dir", "package")


def installed_packages(manifest: DataFrame) -> DataFrame:
    """``dir, package, has_bin`` from the manifests of a ``node_modules`` directory."""
    at = manifest.where(F.col("dir").rlike("(^|/)node_modules/")).withColumn("root", F.regexp_extract("dir", "^(.*?)/?node_modules/(@[^/]+/[^/]+|[^/]+)$", 1)).withColumn("package", F.regexp_extract("dir", "node_modules/(@[^/]+/[^/]+|[^/]+)$", 1))
    return at.where("package <> ''").groupBy(F.col("root").alias("dir"), "package").agg(F.max(F.col("field") == "bin").alias("has_bin"))


def layer_violations(resolved: DataFrame, layers: list[tuple[str, str]], allowed: dict[str, list[str]]) -> DataFrame:
    """``path, target, from_layer, to_layer`` of edges between layers that ``allowed`` does not list; a file's layer is the first whose glob fits."""

    def layer(c: str):
        out = F.lit(None).cast("string")
        for name, glob in reversed(layers):
            out = F.when(F.col(c).rlike(glob_to_regex(glob)), F.lit(name)).otherwise(out)
        return out

    edges = resolved.where("target is not null and type in ('imports', 're-exports', 'dynamic')").select("path", "target").distinct()
    named = edges.select("path", "target", layer("path").alias("from_layer"), layer("target").alias("to_layer")).where("from_layer is not null and to_layer is not null and from_layer <> to_layer")
    fits = [(F.col("from_layer") == a) & F.col("to_layer").isin(*bs) for a, bs in allowed.items() if bs]
    free = fits[0] if fits else F.lit(False)
    for f in fits[1:]:
        free = free | f
    return named.where(~free)


def cross_module_reexports(resolved: DataFrame) -> DataFrame:
    """``path, specifier, target`` of re-exports in an index file that reach outside its directory."""
    index = F.col("path").rlike("(^|/)index[.]ts$")
    outside = ~F.concat(F.lit("/"), "target").startswith(F.concat(F.lit("/"), folder(F.col("path")), F.when(folder(F.col("path")) == "", F.lit("")).otherwise(F.lit("/"))))
    return resolved.where((F.col("type") == "re-exports") & F.col("target").isNotNull() & index & outside).select("path", "specifier", "target").distinct()


def cycle_cuts(resolved: DataFrame, cycles: DataFrame) -> DataFrame:
    """``component, cut_from, cut_to, score``: the edge to cut in each cycle."""
    edges = resolved.where("target is not null and path <> target").select(F.col("path").alias("node"), "target").distinct()
    return graph.edge_cuts(cycles, edges.groupBy("node").agg(F.count("target").alias("degree")))


def trace(resolved: DataFrame, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, kind, path, name, depth`` and edges ``source, target, kind`` from an exported name to all modules that come to use it.

    An edge leads from where a name is offered to a module that re-exports or
    imports it; a whole import or ``export *`` passes it on too.
    """
    key = lambda p, n: F.concat_ws("#", p, n)
    links = resolved.where("target is not null and target <> path")
    passed = links.where("type = 're-exports' and imported <> '*'").select(key("target", "imported").alias("u"), key("path", "local").alias("v"), F.lit("re-exports").alias("kind"))
    offered = origins(resolved).select("path", "name").distinct()
    stars = links.where("type = 're-exports' and imported = '*' and local is null").select("path", "target").distinct()
    over = stars.join(offered.withColumnRenamed("path", "target"), "target").where("name <> 'default'").select(key("target", "name").alias("u"), key("path", "name").alias("v"), F.lit("re-exports").alias("kind"))
    direct = links.where("type = 'imports' and imported is not null and imported <> '*'").select(key("target", "imported").alias("u"), F.concat("path", F.lit("#")).alias("v"), F.lit("imports").alias("kind"))
    opened = links.where("(type = 'imports' and imported = '*') or type = 'dynamic'").select("path", "target").distinct().join(offered.withColumnRenamed("path", "target"), "target").select(key("target", "name").alias("u"), F.concat("path", F.lit("#")).alias("v"), F.lit("imports").alias("kind"))
    edges = written(passed.unionByName(over).unionByName(direct).unionByName(opened).distinct(), "trace-edges")
    spark = resolved.sparkSession
    seen = graph.reachable(edges.select("u", "v"), spark.createDataFrame([(f"{path}#{name}",)], "node string"))
    nodes = seen.select(F.col("node").alias("id"), F.when(F.col("node").endswith("#"), "file").otherwise("symbol").alias("kind"), F.split("node", "#")[0].alias("path"), F.split("node", "#")[1].alias("name"), "depth")
    kept = edges.join(seen.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("u").alias("source"), F.col("v").alias("target"), "kind")
    return nodes, kept
