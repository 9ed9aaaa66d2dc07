"""Listing and reading of source files."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.paths import is_source, matches_any


def read_sources(spark: SparkSession, roots: list[str], exclude: list[str] = (), glob: str = "*.ts") -> DataFrame:
    """``path, source_text, content_hash`` of all source files below ``roots``, read by the executors.

    Declarations and ``node_modules`` are left out, as are paths that fit ``exclude``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(list(roots))
    path = F.regexp_replace("path", "^file:/+", "/")
    files = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("source_text"), F.sha1("content").alias("content_hash"))
    return files.where(is_source(F.col("path")) & ~matches_any(F.col("path"), list(exclude)))


def outside_root(files: DataFrame, root: str, sample: int = 3) -> list[str]:
    """Up to ``sample`` paths that do not lie below ``root``."""
    base = root.rstrip("/") + "/"
    return [r["path"] for r in files.where(~F.col("path").startswith(base)).select("path").orderBy("path").take(sample)]


_JSONC = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.DOTALL)


def parse_jsonc(text: str):
    """JSON with comments and closing commas."""
    bare = _JSONC.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    parts = re.split(r'("(?:\\.|[^"\\])*")', bare)
    return json.loads("".join(p if k % 2 else re.sub(r",(\s*[}\]])", r"\1", p) for k, p in enumerate(parts)))


DETECTORS = ("waste", "barrel", "error-flow", "nesting", "early-return", "collapsible-if", "indirection", "dependencies", "temporal-coupling", "variable-lifetime", "giant-file", "duplicates")
#: Detectors that run only when asked for.
OPT_IN = ("barrel",)


def select_detectors(features: dict | None = None, only: list[str] | None = None) -> list[str]:
    """Detectors to run: all but those that must be asked for and those set to false; ``only`` overrides, but for false on barrel and giant-file."""
    features = features or {}
    unknown = (set(features) | set(only or ())) - set(DETECTORS)
    if unknown:
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    off = {d for d, v in features.items() if v is False}
    if only:
        return [d for d in DETECTORS if d in only and not (d in off and d in ("barrel", "giant-file"))]
    asked = {d for d, v in features.items() if v is True or isinstance(v, dict)}
    return [d for d in DETECTORS if d not in off and (d not in OPT_IN or d in asked)]
