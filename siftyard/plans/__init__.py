"""Queries by name, with the DuckDB SQL that each must equal."""

from siftyard.plans import dedup, keyed, scalars

QUERIES = {**dedup.QUERIES, **keyed.QUERIES, **scalars.QUERIES}
ORACLES = {**dedup.ORACLES, **keyed.ORACLES, **scalars.ORACLES}
