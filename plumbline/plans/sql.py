"""Pieces of SQL that the twins of several modules use."""

from __future__ import annotations

from plumbline import constants as K

NUMBER_KINDS = "('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE')"
IDENTIFIER = (
    "list_has_any(regexp_split_to_array(lower(regexp_replace(column_name, '([a-z])([A-Z])', '\\1_\\2', 'g')), "
    "'[^a-z0-9]+'), ['id', 'code', 'number', 'no'])"
)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def column_facts(name: str, source: str) -> str:
    """(table, ordinal, column, kind, filled, rows) of all columns of a table, looked up from its values."""
    return (f"SELECT '{name}' AS table_name, CAST(ordinal AS INT) AS ordinal, column_name, kind, filled, rows_count FROM "
            "(SELECT row_number() OVER () AS ordinal, column_name, kind FROM (UNPIVOT (SELECT any_value(typeof(COLUMNS('(.*)'))) "
            f"AS \"\\1\" FROM {source}) ON COLUMNS(*) INTO NAME column_name VALUE kind)) JOIN (UNPIVOT (SELECT count(COLUMNS('(.*)')) "
            f"AS \"\\1\" FROM {source}) ON COLUMNS(*) INTO NAME column_name VALUE filled) USING (column_name), "
            f"(SELECT count(*) AS rows_count FROM {source})")


BARE = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


def roles_of(facts: str) -> str:
    """The roles of headers with values, by the accepted names."""
    accepted = ", ".join(f"('{role}', {text(name)})" for role, names in K.ROLE_HEADERS.items() for name in names)
    return (f"SELECT table_name, role, CASE WHEN count(*) = 1 THEN 'matched' ELSE 'ambiguous' END AS status, "
            f"string_agg(column_name, ', ' ORDER BY ordinal) AS columns FROM {facts} JOIN (SELECT DISTINCT role, {BARE.format('name')} AS bare "
            f"FROM (VALUES {accepted}) accepted(role, name)) ON {BARE.format('column_name')} = bare WHERE filled > 0 GROUP BY table_name, role")
