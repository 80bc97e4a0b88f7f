"""The registered queries: each operator over views of the given tables, with its DuckDB twin where SQL can say it."""

from . import documents, facts, groups, labels, learning, profiles, questions, sheets, storage, tokens, trends  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
