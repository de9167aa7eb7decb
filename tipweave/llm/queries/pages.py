"""Queries over raw pages."""

from __future__ import annotations

from tipweave.llm import html_text
from tipweave.llm.queries.registry import query
from tipweave.llm.tables import table


@query("op9_html_text")
def texts(spark, folder):
    return html_text.page_texts(table(spark, folder, "pages"))
