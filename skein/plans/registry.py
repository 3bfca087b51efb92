"""All registered queries of the engine by name, and their SQL twins."""

from __future__ import annotations

from skein.plans import code, modules, rich, tables

FLAGSHIP = "search_tiers"

QUERIES = {**tables.QUERIES, **code.QUERIES, **modules.QUERIES, **rich.QUERIES}
ORACLE: dict[str, str] = {**tables.ORACLE, **code.ORACLE, **modules.ORACLE, **rich.ORACLE}
