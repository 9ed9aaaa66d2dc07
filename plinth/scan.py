"""A scan: source files to one table of findings (the engine's code front end).

Only the facts that the chosen detectors need are extracted. Files that do not
parse are left out of all detectors but ``giant-file`` and are told in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import detectors as D
from plinth.operators import metrics, report
from plinth.operators import modules as M
from plinth.operators.tables import ship_package, written
from plinth.sources import facts, projects
from plinth.sources.control_flow import dead_store_findings, lifetime_findings, mutation_findings, pressure_findings
from plinth.sources.files import select_detectors
from plinth.sources.states import temporal_couplings

#: What a code stands for; the report lists the codes that were found.
CATALOG = (
    ("DEAD_STORE", "a value is written and never read"),
    ("BARREL", "a module surface is not explicit"),
    ("ERROR_FLOW", "an error is lost, hidden or no Error"),
    ("NESTING", "control flow is deep or dense"),
    ("EARLY_RETURN", "an early exit would flatten the code"),
    ("COLLAPSIBLE", "nested conditions can be one"),
    ("INDIRECTION", "a name only passes on to another"),
    ("DEPENDENCIES", "modules are unused, unresolved or circular"),
    ("GIANT_FILE", "a file has too many lines"),
    ("LIFETIME", "a variable lives long or beside many others"),
    ("CLONE", "code is repeated"),
    ("TEMPORAL", "a state must be written before it is read"),
    ("LINT", "a rule of style is broken"),
)


@dataclass(frozen=True)
class Options:
    """Limits of the detectors; all are independent of the corpus, so a finding never hangs on unrelated files."""

    features: dict | None = None
    only: tuple[str, ...] = ()
    min_size: int = 12
    max_lines: int = 1000
    max_forward_depth: int = 1
    max_lifetime: int = 30
    max_mutations: int | None = None
    entry: tuple[str, ...] = ()
    layers: tuple[tuple[str, str], ...] = ()
    allowed: dict[str, list[str]] | None = None


@dataclass(frozen=True)
class Project:
    """Facts beside the sources: manifests, path mappings, workspace packages, installed packages, ambient types, and
    ``thenables(path, start_off, end_off)``, expressions that a type checker knows to be promises.

    What is absent is not guessed: without manifests no package is told as unlisted
    or unused, without installed packages none as unused.
    """

    manifest: DataFrame | None = None
    configs: DataFrame | None = None
    spaces: DataFrame | None = None
    installed: DataFrame | None = None
    ambient: DataFrame | None = None
    thenables: DataFrame | None = None


def read_project(spark: SparkSession, roots: list[str]) -> Project:
    """Project facts below ``roots``."""
    own = written(projects.manifests(projects.read_texts(spark, roots, "package.json")), "manifests")
    there = written(projects.manifests(projects.read_texts(spark, roots, "package.json", installed=True)), "installed")
    texts = projects.read_texts(spark, roots, "*.json").where("path not like '%/package.json'")
    pnpm = projects.read_texts(spark, roots, "pnpm-workspace.yaml")
    return Project(own, written(projects.tsconfigs(texts), "configs"), written(projects.workspaces(spark, own, pnpm), "spaces"), written(M.installed_packages(there), "installed"), written(projects.ambient_types(texts), "ambient"))


@dataclass(frozen=True)
class Report:
    findings: DataFrame
    catalog: DataFrame
    errors: DataFrame
    detectors: list[str]


def scan(spark: SparkSession, files: DataFrame, options: Options = Options(), project: Project = Project()) -> Report:  # noqa: B008
    """Findings of ``files(path, source_text)``, each once, with the catalog rows of the codes found.

    Entries are those of the options and the source files that manifests name.
    """
    ship_package(spark)
    chosen = select_detectors(options.features, list(options.only) or None)
    files = written(files.select("path", "source_text"), "files")
    nodes = written(facts.ast_nodes(files), "nodes") if set(chosen) & {"barrel", "error-flow", "nesting", "early-return", "collapsible-if", "indirection"} else None
    relations = written(facts.relations(files), "relations") if set(chosen) & {"barrel", "indirection", "dependencies"} else None
    resolved = written(M.resolve(relations, files, project.configs, project.spaces), "resolved") if relations is not None and set(chosen) & {"barrel", "dependencies"} else None
    line0 = F.lit(0)

    def rows(df: DataFrame, category: str, code: str, kind, label, line=None, detail=None) -> DataFrame:
        return report.finding(df, category, code, F.col("path"), F.col("line") if line is None else line, kind, label, detail=detail)

    kind = F.col("kind")
    parts: list[DataFrame] = []
    if "waste" in chosen:
        parts.append(rows(dead_store_findings(files), "waste", "DEAD_STORE", kind, F.concat(F.col("var"), F.lit(" is written and not read")), detail=F.concat_ws(":", "line", "var")))
    if "barrel" in chosen:
        parts.append(rows(D.barrel_statements(nodes), "barrel", "BARREL", kind, kind, detail=F.col("line").cast("string")))
        parts.append(rows(D.deep_imports(resolved, files), "barrel", "BARREL", kind, F.col("target"), line0, F.col("target")))
        parts.append(rows(M.cross_module_reexports(resolved), "barrel", "BARREL", F.lit("cross-module-reexport"), F.col("specifier"), line0, F.col("specifier")))
    if "error-flow" in chosen:
        parts.append(rows(D.error_flow(nodes, project.thenables), "error-flow", "ERROR_FLOW", kind, kind, detail=F.col("line").cast("string")))
    if "nesting" in chosen:
        parts.append(rows(D.nesting_findings(nodes), "nesting", "NESTING", kind, F.concat_ws(",", "signals"), detail=F.to_json(F.struct("fn_id", "complexity", "max_depth", "callback_depth"))))
    if "early-return" in chosen:
        parts.append(rows(D.early_returns(nodes), "early-return", "EARLY_RETURN", kind, kind, detail=F.to_json(F.struct("fn_id", "score"))))
    if "collapsible-if" in chosen:
        parts.append(rows(D.collapsible_ifs(nodes), "collapsible-if", "COLLAPSIBLE", kind, kind, detail=F.to_json(F.struct("if_id", "score"))))
    if "indirection" in chosen:
        wrappers = written(D.thin_wrappers(nodes, relations), "wrappers")
        parts.append(rows(wrappers, "indirection", "INDIRECTION", F.lit("thin-wrapper"), F.concat_ws(" passes on to ", "name", "callee"), detail=F.col("name")))
        parts.append(rows(D.forward_chains(wrappers, options.max_forward_depth), "indirection", "INDIRECTION", F.lit("forward-chain"), F.concat(F.col("name"), F.lit(" passes on "), F.col("depth").cast("string"), F.lit(" times")), line0, F.col("name")))
        parts.append(rows(D.type_remaps(nodes), "indirection", "INDIRECTION", F.lit("type-remap"), F.lit("alias of a type name"), detail=F.col("line").cast("string")))
        parts.append(rows(D.interface_rewraps(nodes), "indirection", "INDIRECTION", F.lit("interface-rewrap"), F.lit("empty interface"), detail=F.col("line").cast("string")))
    if "dependencies" in chosen:
        found = written(D.circular_dependencies(resolved), "cycles")
        cuts = M.cycle_cuts(resolved, found).select("component", F.concat_ws(" -> ", "cut_from", "cut_to").alias("cut"))
        cycles = found.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "node"))), lambda x: x["node"]), " -> ").alias("way")).join(cuts, "component", "left")
        deps = lambda df, what, label, detail=None: parts.append(rows(df, "dependencies", "DEPENDENCIES", F.lit(what), label, line0, label if detail is None else detail))
        deps(cycles.withColumnRenamed("component", "path"), "circular-dependency", F.col("way"), F.to_json(F.struct("way", "cut")))
        deps(M.unresolved(resolved), "unresolved-import", F.col("specifier"))
        deps(M.duplicate_exports(resolved).withColumnRenamed("first_module", "path"), "duplicate-export", F.col("name"), F.concat_ws("#", "origin_path", "name"))
        if options.layers:
            deps(M.layer_violations(resolved, list(options.layers), options.allowed or {}), "layer-violation", F.concat_ws(" -> ", "from_layer", "to_layer"), F.col("target"))
        entries, held, surface = spark.createDataFrame([(e,) for e in options.entry], "path string"), None, True
        if project.manifest is not None:
            held = written(M.nested_files(files, project.manifest), "nested")
            named = project.manifest.where("field = 'entry'").select(F.explode(F.array("value", F.regexp_replace("value", r"\.js$", ".ts"), F.concat("value", F.lit("/index.ts")))).alias("path"))
            surface = bool(options.entry) or named.isEmpty() or not named.join(files, "path", "left_semi").isEmpty()
            entries = written(entries.unionByName(named.join(files.select("path"), "path", "left_semi")).distinct(), "entries")
            deps(M.unlisted_dependencies(resolved, project.manifest), "unlisted-dependency", F.col("package"))
            if project.installed is not None:
                unused = M.unused_dependencies(resolved, project.manifest, project.installed, project.ambient)
                deps(unused.withColumn("path", F.concat("dir", F.lit("/package.json"))), "unused-dependency", F.col("package"))
        if surface and not entries.isEmpty():
            # What entries do not reach is told as a file; users of nested packages may lie outside. Both are held.
            unused = written(D.unused_files(resolved, files, entries), "unused")
            if held is not None:
                unused = unused.join(held, "path", "left_anti")
            deps(unused, "unused-file", F.lit("no entry reaches it"), F.lit(""))
            deps(M.dead_exports(resolved, entries, unused if held is None else unused.unionByName(held)), "dead-export", F.col("name"))
    if "variable-lifetime" in chosen:
        parts.append(rows(lifetime_findings(files, options.max_lifetime), "variable-lifetime", "LIFETIME", F.lit("variable-lifetime"), F.concat(F.col("var"), F.lit(" lives "), F.col("lines").cast("string"), F.lit(" lines")), detail=F.concat_ws(":", "line", "var", "burden")))
        parts.append(rows(pressure_findings(files), "variable-lifetime", "LIFETIME", F.lit("liveness-pressure"), F.concat(F.col("max_live").cast("string"), F.lit(" variables live at once")), line0, F.col("fn").cast("string")))
        if options.max_mutations is not None:
            parts.append(rows(mutation_findings(files, options.max_mutations), "variable-lifetime", "LIFETIME", F.lit("mutation-density"), F.concat(F.col("var"), F.lit(" is written "), F.col("writes").cast("string"), F.lit(" times")), line0, F.concat_ws(":", "fn", "var")))
    if "temporal-coupling" in chosen:
        parts.append(rows(temporal_couplings(files), "temporal-coupling", "TEMPORAL", F.lit("temporal-coupling"), F.col("state"), detail=F.concat_ws(":", "state", "writers", "readers")))
    if "giant-file" in chosen:
        parts.append(rows(metrics.oversized(files, "source_text", options.max_lines), "giant-file", "GIANT_FILE", F.lit("giant-file"), F.concat(F.col("n_lines").cast("string"), F.lit(" lines")), F.lit(1)))
    if "duplicates" in chosen:
        clones = D.clone_tiers(facts.fingerprints(files, options.min_size))
        made = rows(clones, "duplicates", "CLONE", F.col("tier"), F.col("name"), detail=F.concat_ws(":", "start_off", "fp"))
        parts.append(made)
    findings = report.flatten(*parts) if parts else report.finding(files.limit(0), "none", "NONE", F.col("path"), line0, F.lit(""), F.lit(""))
    findings = written(findings, "findings")
    catalog = report.seen_catalog(findings, spark.createDataFrame(list(CATALOG), "code string, cause string"))
    return Report(findings, catalog, facts.parse_errors(files), chosen)


def lint(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Findings of the lint rules that source text alone decides, in the uniform table."""
    ship_package(spark)
    files = written(files.select("path", "source_text"), "files")
    nodes, relations = written(facts.ast_nodes(files), "nodes"), written(facts.relations(files), "relations")
    line0 = F.lit(0)

    def rows(df: DataFrame, rule, label, line=None) -> DataFrame:
        at = F.col("line") if line is None else line
        return report.finding(df, "lint", "LINT", F.col("path"), at, F.lit(rule) if isinstance(rule, str) else rule, label, detail=F.concat_ws(":", at.cast("string"), label))

    text = F.lit("")
    parts = [
        rows(D.simple_lints(nodes), F.col("rule"), text),
        rows(D.unused_imports(nodes, relations), "unused-imports", F.col("local"), line0),
        rows(D.tombstones(files), "no-tombstone", text, line0),
        rows(D.exported_classes(nodes), "single-exported-class", text, line0),
        rows(D.member_order(nodes), "member-ordering", F.coalesce("name", text)),
        rows(D.global_mutations(nodes), "no-globalthis-mutation", text),
        rows(D.test_file_mapping(files, nodes), "test-unit-file-mapping", F.col("kind"), line0),
        rows(D.describe_titles(nodes, relations), "test-describe-sut-name", F.col("title")),
    ]
    return report.flatten(*parts)
