"""What the subpackage adds to the registered queries."""

from __future__ import annotations

import corpus_pipeline

from folio.llm.queries import ORACLES, QUERIES


def queries() -> dict:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
