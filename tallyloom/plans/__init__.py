"""The registered queries, by letter of the operator inventory."""

from . import expressions, flagship, ingest, joins, metrics, models, streams, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
