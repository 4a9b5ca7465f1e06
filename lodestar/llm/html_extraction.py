"""HTML extraction by a tree-structured graphical model.

A page's block elements are the nodes of a tree; each is content or not. Features
of a node give its own potential, a table gives the potential of parent and child
together, and sum-product messages up and down the tree give each node's exact
marginal. The text of nodes whose marginal is a half or more is the main text.
Potentials are fitted to labelled pages: by default to PAGES pages that are put
together at random from common layouts, with labels; other labelled pages can be
given. Fitting is bounded by that number; every page is extracted whole.

Defined results: null or empty html, and pages without content, give an empty
text; broken markup is read as far as it goes; repeated rows get equal results;
an empty table gives an empty result; other columns are handed on and never leave
the JVM, and one named as the text is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import html_model
from lodestar.llm.arrow import small_batches

#: Labelled pages that a fit takes.
PAGES = 400


@lru_cache(maxsize=1)
def default_model() -> html_model.Model:
    return html_model.fit(html_model.labelled_pages(PAGES))


def extract(pages: DataFrame, model: html_model.Model | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The rows of `pages` without the html, with its main text as `text_col`, which replaces a column of that name."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.arrow_udf("string")
    def main_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            yield pa.array([html_model.main_text(model, x.as_py()) for x in batch], pa.string())

    found = main_texts.asNondeterministic()(F.col(html_col))  # else a filter on the text would run it a second time
    kept = [c for c in pages.columns if c not in (html_col, text_col)]
    return small_batches(pages).select(*kept, found.alias(text_col))


def op4_html_extraction(pages: DataFrame) -> DataFrame:
    """One row for each page: its main text and the text's code points."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
