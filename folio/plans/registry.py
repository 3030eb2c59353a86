"""Collects the queries and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text", "relational", "reading", "outline", "pairing", "workspace", "publication", "parsing", "showing")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"folio.plans.{name}"), what)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
