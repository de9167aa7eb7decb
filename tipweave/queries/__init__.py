"""Every operator as a query over the given tables, each with the SQL that must agree with it."""

from tipweave.queries import catalogue, chat, entities, jobs, names, stores, text, venues  # noqa: F401
from tipweave.queries.registry import QUERIES, SQL  # noqa: F401
