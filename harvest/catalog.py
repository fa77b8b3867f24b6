"""All registered queries of the library's own operators, and their DuckDB SQL.

``CASES`` are small fixed inputs with fixed results of functions whose registered query reads the tables; the tests run them.
"""

from __future__ import annotations

from .plans import crawls, derived, extract, live, pipeline, scalars, store, streams, whole

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (store, scalars, streams, pipeline, extract):
    QUERIES |= _m.Q
    ORACLES |= _m.O
CASES = {k: (QUERIES[k], ORACLES.get(k)) for k in derived.Q if k in QUERIES}
for _m in (derived, whole, crawls, live):
    QUERIES |= _m.Q
    ORACLES |= _m.O
