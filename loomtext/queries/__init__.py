"""The registered queries of the core; SQL stands beside them where SQL can say the same."""

from loomtext.queries.registry import ORACLE_SQL, QUERIES
from loomtext.queries import cleaning, corpus, examples, metrics, sampling, storage, telemetry, tokens  # noqa: F401, E402

__all__ = ["ORACLE_SQL", "QUERIES"]
