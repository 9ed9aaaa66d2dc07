"""Functions of paths and specifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    """An anchored pattern: ``**/`` any directories, ``**`` anything, ``*`` within a name, ``?`` one character."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path fits any glob (S4, P15); no globs: false."""
    return path.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs)) if globs else F.lit(False)


def is_source(path: Column) -> Column:
    """A ``.ts`` file that is no declaration and lies in no ``node_modules`` (S3)."""
    return path.endswith(".ts") & ~path.endswith(".d.ts") & ~path.rlike("(^|/)node_modules(/|$)")


def normalize_file(path: Column) -> Column:
    """From the last ``/src/`` on, else the base name; slashes forward."""
    p = F.regexp_replace(path, r"\\", "/")
    tail = F.regexp_extract(p, r"^.*/(src/.*)$", 1)
    return F.when(tail != "", tail).otherwise(F.regexp_extract(p, r"([^/]*)$", 1))


def project_relative(path: Column, root: str) -> Column:
    """The path below ``root``, or as it is if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def package_name(specifier: Column) -> Column:
    """The package of an import specifier: two parts if scoped; null for relative and absolute ones."""
    parts = F.split(specifier, "/")
    scoped = F.when(F.size(parts) >= 2, F.concat_ws("/", F.slice(parts, 1, 2)))
    return F.when(specifier.rlike(r"^(\.|/|$)"), F.lit(None).cast("string")).when(specifier.startswith("@"), scoped).otherwise(parts[0])


def mangled_types_package(package: Column) -> Column:
    """``@types/`` name of a package: a scope is joined by two underscores."""
    return F.concat(F.lit("@types/"), F.regexp_replace(F.regexp_replace(package, "^@", ""), "/", "__"))


def is_builtin(specifier: Column) -> Column:
    """Modules that the runtime brings: ``node:``, ``bun:`` and ``bun``."""
    return specifier.rlike("^(node:|bun:)") | (specifier == "bun")


def star_apply(specifier: Column, pattern: str, target: str) -> Column:
    """What a one-star path pattern maps a specifier to, or null; the star's text may be empty but parts may not overlap."""
    if "*" not in pattern:
        return F.when(specifier == pattern, F.lit(target))
    head, tail = pattern.split("*", 1)
    fits = specifier.startswith(head) & specifier.endswith(tail) & (F.length(specifier) >= len(head) + len(tail))
    middle = F.substr(specifier, F.lit(len(head) + 1), F.length(specifier) - len(head) - len(tail))
    left, right = target.split("*", 1) if "*" in target else (target, "")
    return F.when(fits, F.concat(F.lit(left), middle if "*" in target else F.lit(""), F.lit(right)))


def evidence_line(text: Column, offset: Column) -> Column:
    """The trimmed line that holds a character offset, from 0."""
    before = F.element_at(F.split(F.substr(text, F.lit(1), offset), "\n"), -1)
    after = F.element_at(F.split(F.substr(text, offset + 1), "\n"), 1)
    return F.trim(F.concat(before, after))
