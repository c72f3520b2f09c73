"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from ..session import prepare
from . import q_ingest, q_lake, q_ops, q_sql, q_state, q_stream

MODULES = [q_ingest, q_lake, q_sql, q_state, q_ops, q_stream]


def _prepared(query):
    def run(spark, sf_dir):
        return query(prepare(spark), sf_dir.rstrip("/"))
    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def queries():
    return {name: _prepared(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
