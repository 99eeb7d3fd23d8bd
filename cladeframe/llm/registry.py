"""Queries of the corpus operators (one opN_<name> each) and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import queries as q

QUERIES = {name: getattr(q, name) for name in q.NAMES}
ORACLES = dict(q.SQL)
