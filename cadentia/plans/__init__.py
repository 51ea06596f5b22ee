"""Registered queries by subject, each with the SQL that gives the same rows."""

from __future__ import annotations

from cadentia.plans import body, care, files, imports, load, messages, power

_MODULES = (power, load, body, care, files, imports, messages)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in _MODULES for name, q in m.ORACLES.items()}
