"""Names that stand for the same thing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions.text import camel_split, fuzzy_score, initials


def resolve(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """The name's canonical form: by alias, else by the initials of its camel-case parts as an alias, else itself."""
    table = F.create_map(*(F.lit(x) for pair in (aliases or schema.ALIASES).items() for x in pair))
    known = F.try_element_at(table, F.lower(name))
    parts = camel_split(name)
    short = F.when(F.size(parts) >= 2, F.try_element_at(table, initials(parts)))
    return F.when(F.length(name) < 2, name).when(known == F.lower(name), name).otherwise(F.coalesce(known, short, name))


def changed(name: Column, aliases: dict[str, str] | None = None) -> Column:
    return resolve(name, aliases) != name


def canonical(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """The resolved name without the first suffix of the list that it ends with, if three characters remain."""
    r = resolve(name, aliases)
    out = r
    for s in reversed(schema.SUFFIXES):
        out = F.when(F.lower(r).endswith(s) & (F.length(r) - len(s) >= 3), F.substring(r, F.lit(1), F.length(r) - len(s))).otherwise(out)
    return out


def similar(names: DataFrame, queries: Sequence[str], least: float = 0.75) -> DataFrame:
    """(name, other, score) for each asked name: the other known names that are alike enough.

    The asked names are a stated list: each known name is compared with each of them where it is read, without a join.
    """
    known = names.select(F.col("name").alias("other")).distinct()
    pairs = known.select("other", F.explode(F.array(*(F.lit(q) for q in dict.fromkeys(queries)))).alias("name")).filter("name <> other")
    return pairs.withColumn("score", fuzzy_score(F.col("name"), F.col("other"))).filter(F.col("score") >= least).select("name", "other", "score")
