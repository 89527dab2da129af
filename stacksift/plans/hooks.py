"""Places where a user plugs in functions: evidence, decisions, translations, versions.

Each hook is a table the user prepares, or a function over batches of texts that runs
inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.titles import aggressive_title, conservative_title, lookup_title
from ..sources.pages import page_media

BatchFunction = Callable[[list[str]], list[str]]

# Version stored on a row, and the function that produces rows of that version.
TITLE_CLEANERS = {0: lookup_title, 1: conservative_title, 2: aggressive_title}
MEDIA_EXTRACTORS = {7: page_media}


def title_of_version(title: str, version: Column) -> Column:
    """The title as the cleaner of the row's version gives it; null for a version that is not known."""
    out = F.lit(None).cast("string")
    for number, clean in TITLE_CLEANERS.items():
        out = F.when(version == number, clean(title)).otherwise(out)
    return out


def media_of_version(pages: DataFrame, version: int, *args, **kwargs) -> DataFrame:
    """Media of pages by the extractor of a version."""
    if version not in MEDIA_EXTRACTORS:
        raise ValueError(f"no extractor of version {version}")
    return MEDIA_EXTRACTORS[version](pages, *args, **kwargs)


#: Exceptions after which the same request is worth another try.
TRANSIENT = (TimeoutError, ConnectionError)


def _message(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _tried(function: Callable[[list[str]], list], texts: list[str]) -> list:
    """Answers of a function; the exception for every text if it raises."""
    try:
        return list(function(texts))
    except Exception as error:  # becomes an outcome of each text
        return [error] * len(texts)


def answer(requests: DataFrame, text: str, result: str, function: BatchFunction) -> DataFrame:
    """``requests`` with a column ``result`` holding what ``function`` makes of ``text``, and ``error``.

    The function gets one Arrow batch of texts at a time and returns as many answers. An
    answer that is an exception, or an exception raised for the batch, becomes an error.
    """
    schema = T.StructType(
        [*requests.schema.fields, T.StructField(result, T.StringType()), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = _tried(function, batch[text].tolist())
            failed = [isinstance(a, Exception) for a in answers]
            yield batch.assign(
                **{result: [None if f else a for a, f in zip(answers, failed)]},
                error=[_message(a) if f else None for a, f in zip(answers, failed)],
            )

    return requests.mapInPandas(run, schema)


def entity_lookup(provider: Callable[[list[str]], list[list[dict]]], candidate_schema: T.StructType):
    """An evidence provider as a ``find`` function for ``two_pass``.

    ``provider`` returns a list of candidate records, or an exception, for every query of a
    batch. Errors come back as rows without a candidate: ``query, candidate, error,
    transient``.
    """
    schema = T.StructType([
        T.StructField("query", T.StringType()), T.StructField("candidate", candidate_schema),
        T.StructField("error", T.StringType()), T.StructField("transient", T.BooleanType()),
    ])

    def find(titles: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                queries = batch["query"].tolist()
                rows = []
                for query, found in zip(queries, _tried(provider, queries)):
                    if isinstance(found, Exception):
                        rows.append((query, None, _message(found), isinstance(found, TRANSIENT)))
                    else:
                        rows += [(query, candidate, None, None) for candidate in found]
                yield pd.DataFrame(rows, columns=["query", "candidate", "error", "transient"])

        return titles.select("query").distinct().mapInPandas(run, schema)

    return find
