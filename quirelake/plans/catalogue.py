"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from quirelake.plans import editing, files, records, workspace

MODULES = (records, workspace, files, editing)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
