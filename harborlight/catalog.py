"""Every registered query of the job-market engine and its SQL counterpart."""

from __future__ import annotations

from harborlight.plans import board, changes, crawl, feeds, fields, find, ingest, intake, lists, live, nested, pages, reading, routes, work

FLAGSHIP = "company_summaries"
_ALL = [board.R, crawl.R, ingest.R, work.R, changes.R, live.R, lists.R, reading.R, fields.R, feeds.R, nested.R, routes.R, intake.R, find.R, pages.R]
QUERIES = {k: f for r in _ALL for k, f in r.queries.items()}
ORACLES = {k: s for r in _ALL for k, s in r.oracles.items()}
