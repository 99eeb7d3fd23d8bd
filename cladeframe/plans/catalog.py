"""Registered queries of the sequence and tree operators, with equivalent SQL."""

from __future__ import annotations

from . import q_sequences, q_trees

QUERIES = q_sequences.QUERIES | q_trees.QUERIES
ORACLES = q_sequences.ORACLES | q_trees.ORACLES
