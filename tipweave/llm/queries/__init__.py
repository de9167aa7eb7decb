"""The dealt operators as queries over the given tables."""

from tipweave.llm.queries import duplicates, packs, pages, quality, rows, search, talks, vectors  # noqa: F401
from tipweave.llm.queries.registry import QUERIES, SQL  # noqa: F401
