"""All ledger queries and their oracles."""

from __future__ import annotations

from . import billing, changes, files, linking, monthly, reads, upkeep

MODULES = (reads, billing, changes, linking, monthly, upkeep, files)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: o for m in MODULES for k, o in m.ORACLES.items()}
