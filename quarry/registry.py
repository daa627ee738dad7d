"""All queries with their SQL twins, by name."""

from .plans import aggregates, decoding, dialect, extensions, filters, generation, joins, retrieval, rules, scalars, sources, streams, vectors, windows  # noqa: F401

QUERIES, ORACLES = dialect.QUERIES, dialect.ORACLES
