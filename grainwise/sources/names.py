"""Table names from file names and qualified source names."""

from __future__ import annotations

import re


def sanitize_name(name: str) -> str:
    """A name usable in SQL: word characters, lower case, not starting with a digit."""
    cleaned = re.sub(r"\W+", "_", name).strip("_").lower()
    if not cleaned:
        return "table"
    return "t_" + cleaned if cleaned[0].isdigit() else cleaned


def local_name(table: str) -> str:
    """The last three parts of a qualified name, each made usable in SQL."""
    return ".".join(map(sanitize_name, table.split(".")[-3:]))
