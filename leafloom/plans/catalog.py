"""Every registered query and its SQL."""

from __future__ import annotations

from leafloom.plans import checks, formats, furniture, grids, layout, notes, pages, pagetables, prose, readings, reports, scores, tables, tokens, verify

FLAGSHIP = "typed_blocks"
_ALL = [prose.R, tokens.R, tables.R, pages.R, readings.R, formats.R, checks.R, layout.R, verify.R, furniture.R, scores.R, notes.R, grids.R, pagetables.R, reports.R]
QUERIES = {name: q for r in _ALL for name, q in r.queries.items()}
ORACLES = {name: s for r in _ALL for name, s in r.oracles.items()}
