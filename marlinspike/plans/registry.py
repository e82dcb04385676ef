"""All queries outside the training-text subpackage, with their SQL equivalents."""

from . import annotation, queue, search, texts

_PARTS = (search, texts, annotation, queue)
QUERIES = {name: run for part in _PARTS for name, run in part.REGISTRY.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.REGISTRY.oracles.items()}
