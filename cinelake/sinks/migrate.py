"""Tables and settings of older versions, read as the latest.

A migration is data: for each version the columns that it adds, with their default, and the names that it changes.  What
is to do is told by the difference of the columns found and wanted, so a table may be migrated any number of times.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Migration(NamedTuple):
    """What ``version`` changed: columns added, as (name, type, default), and names changed, from old to new."""

    version: int
    added: tuple[tuple[str, str, object], ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()


# What each version of the table of jobs brought.
JOBS = (
    Migration(1, (("preset_overrides_json", "string", None), ("current_stage", "string", None))),
    Migration(2, (("last_failed_stage", "string", None), ("resume_from_stage", "string", None))),
    Migration(3, (("retry_count", "int", 0),)),
)


def difference(found: StructType, wanted: StructType) -> list[tuple[str, str, str]]:
    """(column, what is the matter, types): ``missing``, ``unknown`` or ``type``, in the order of the wanted columns."""
    have, want = ({f.name: f.dataType.simpleString() for f in s} for s in (found, wanted))
    out = [(c, "missing", t) for c, t in want.items() if c not in have]
    out += [(c, "type", f"{have[c]} for {t}") for c, t in want.items() if c in have and have[c] != t]
    return out + [(c, "unknown", t) for c, t in have.items() if c not in want]


def stepped(df: DataFrame, step: Migration) -> DataFrame:
    """``df`` after one migration.  What it finds done stays; if a name of either side is there, the new one's values win."""
    for old, new in step.renamed:
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(new, old)).drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    made = {}
    for name, kind, default in step.added:
        value = F.lit(default).cast(kind)
        made[name] = F.coalesce(F.col(name).cast(kind), value) if name in df.columns else value
    return df.withColumns(made)


def migrated(df: DataFrame, migrations: tuple[Migration, ...] = JOBS, version: int = 0) -> DataFrame:
    """A table of ``version`` as of the last migration: the later ones, in the order of their versions."""
    todo = sorted((m for m in migrations if m.version > version), key=lambda m: m.version)
    return reduce(stepped, todo, df)


def union_of_versions(tables: list[tuple[DataFrame, int]], migrations: tuple[Migration, ...] = JOBS) -> DataFrame:
    """Tables of several versions as one; a column that only some have is null in the others."""
    every = [migrated(df, migrations, version) for df, version in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)


#: Settings whose key changed: section, old key, new key.
LEGACY_KEYS = (("hardware", "prefer_nvenc", "prefer_hardware_encoder"),)


def legacy_values(settings: Column, keys: tuple[tuple[str, str, str], ...] = LEGACY_KEYS) -> Column:
    """(section.key, flag) of each changed setting of a JSON text: the new key's value, else that of the old key as a flag.

    As a flag null, false, 0, the empty text, the empty list and the empty map are false, anything else is true.  A setting
    that has neither key is null, and so is one of a section that is no map.
    """

    def flag(section: str, old: str, new: str) -> Column:
        document = F.try_parse_json(settings)
        part = F.try_variant_get(document, f"$.{section}", "map<string,variant>")
        has = lambda k: F.coalesce(F.array_contains(F.map_keys(part), F.lit(k)), F.lit(False))
        text = F.to_json(F.try_element_at(part, F.lit(old)))
        is_set = ~F.coalesce(text, F.lit("null")).isin("null", "false", "0", "0.0", '""', "[]", "{}")
        return F.when(has(new), F.try_variant_get(document, f"$.{section}.{new}", "boolean")).when(has(old), is_set)

    return F.create_map(*(x for s, old, new in keys for x in (F.lit(f"{s}.{new}"), flag(s, old, new))))
