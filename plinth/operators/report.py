"""Findings in one uniform table: ids, flattening, catalog, digests, stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the uniform table.
COLUMNS = ("id", "category", "code", "file", "line", "kind", "label", "group_id", "is_primary", "detail")


def short_id(category: str | Column, *seed: Column) -> Column:
    """``category-`` and the first 12 hex digits of the SHA-1 of the seed's parts."""
    name = F.lit(category) if isinstance(category, str) else category
    return F.concat(name, F.lit("-"), F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in seed))), 1, 12))


def finding(df: DataFrame, category: str, code: str, file: Column, line: Column, kind: Column, label: Column, group_id: Column | None = None, is_primary: Column | None = None, detail: Column | None = None) -> DataFrame:
    """A detector's rows in the uniform schema (D14); the id is made from the content, so equal findings share one."""
    text = F.lit(None).cast("string")
    detail = text if detail is None else detail
    return df.select(
        short_id(category, F.lit(category), F.lit(code), file, kind, label, detail).alias("id"), F.lit(category).alias("category"), F.lit(code).alias("code"),
        file.cast("string").alias("file"), line.cast("long").alias("line"), kind.alias("kind"), label.alias("label"),
        (text if group_id is None else group_id).alias("group_id"), (F.lit(None).cast("boolean") if is_primary is None else is_primary).alias("is_primary"), detail.alias("detail"),
    )


def flatten(*parts: DataFrame) -> DataFrame:
    """All findings, each id once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["id"])


def seen_catalog(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows whose code was found."""
    return catalog.join(findings.select("code").distinct(), "code", "left_semi")


def digest(df: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """``keys, digest``: SHA-1 over each key's parts in order, joined by a bar.

    Parts are hashed first, so what a key gathers is 40 characters a row; keys with
    very many rows should be split by a bucket and digested twice.
    """
    return df.groupBy(*keys).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.sha1(part))), "|")).alias("digest"))
