"""Recognise identifier headers and retail roles from column names.

Headers are metadata and live on the driver; the ``*_expr`` twins do the same over a
(table, column) frame, for a whole lake's catalog.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.constants import IDENTIFIER_TOKENS, ROLE_HEADERS


def is_identifier(name: str) -> bool:
    """True when a whole word of the header (snake, spaced or camel case) marks an identifier."""
    words = re.split(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+", name)
    return not {word.lower() for word in words}.isdisjoint(IDENTIFIER_TOKENS)


def identifier_expr(name: Column) -> Column:
    words = F.split(F.lower(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", "_")), "[^a-z0-9]+")
    return F.arrays_overlap(words, F.array(*[F.lit(t) for t in IDENTIFIER_TOKENS]))


def bare_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def bare_name_expr(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


@dataclass(frozen=True)
class Roles:
    """Role -> column where exactly one header fits; role -> candidates where several do."""

    matches: dict[str, str] = field(default_factory=dict)
    ambiguous: dict[str, list[str]] = field(default_factory=dict)

    def has(self, *roles: str) -> bool:
        return all(role in self.matches for role in roles)

    def get(self, role: str) -> str | None:
        return self.matches.get(role)


def resolve_roles(columns: list[str]) -> Roles:
    roles = Roles()
    for role, headers in ROLE_HEADERS.items():
        known = set(map(bare_name, headers))
        found = [column for column in columns if bare_name(column) in known]
        if len(found) == 1:
            roles.matches[role] = found[0]
        elif found:
            roles.ambiguous[role] = found
    return roles


def role_table(headers: DataFrame, table: str = "table_name", column: str = "column_name",
               ordinal: str = "ordinal") -> DataFrame:
    """Roles for many tables at once: (table, role, status, columns), from a header frame."""
    spark = headers.sparkSession
    # A fixed list of about forty aliases, so the broadcast does not grow with the data.
    known = spark.createDataFrame(
        [(role, bare_name(header)) for role, accepted in ROLE_HEADERS.items() for header in accepted],
        "role string, bare string",
    ).distinct()
    return (
        headers.select(table, column, ordinal, bare_name_expr(F.col(column)).alias("bare"))
        .join(F.broadcast(known), "bare")
        .groupBy(table, "role")
        .agg(F.array_sort(F.collect_list(F.struct(ordinal, column))).alias("found"))
        .select(
            table, "role",
            F.when(F.size("found") == 1, "matched").otherwise("ambiguous").alias("status"),
            F.col(f"found.{column}").alias("columns"),
        )
    )
