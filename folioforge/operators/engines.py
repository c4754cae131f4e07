"""Hooks for engines and filters that live outside the library.

A hook is a named place with an order of handlers; the first that gives a result wins. What
runs on rows (rasterising, recognition, conversion) is registered as a function on pandas
batches, so Spark ships it to executors. Without any engine the null engine answers: pages
come back without text, images unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Hooks whose first result counts, and hooks that all handlers hear.
FIRST = {
    "rasterise_page", "filter_recognition_image", "filter_page_image", "filter_page", "recognise", "archive",
    "optimise", "optimising_enabled", "executor", "progress",
}
ALL = {"initialise", "add_options", "register_options", "check_options", "validate"}


@dataclass
class Hooks:
    """A registry: later registrations are asked first."""

    handlers: dict[str, list[Callable]] = field(default_factory=dict)

    def register(self, hook: str, handler: Callable) -> None:
        if hook not in FIRST | ALL:
            raise ValueError(f"unknown hook {hook}")
        self.handlers.setdefault(hook, []).insert(0, handler)

    def call(self, hook: str, *args, **kwargs):
        """The first result that is not None, or for hooks that all hear the list of them."""
        results = (h(*args, **kwargs) for h in self.handlers.get(hook, []))
        known = (r for r in results if r is not None)
        return next(known, None) if hook in FIRST else list(known)


def first_success(attempts: list[Column]) -> Column:
    """Result of the first attempt that has one, and its number from 1."""
    which = F.lit(None).cast("int")
    for i, a in reversed(list(enumerate(attempts, 1))):
        which = F.when(a.isNotNull(), i).otherwise(which)
    return F.struct(F.coalesce(*attempts).alias("result"), which.alias("attempt"))


PAGE_RESULT = "doc_id long, pageno int, text string, orientation int, confidence double"


def null_engine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """No text, no rotation: what a page gives where no engine is installed."""
    for pages in batches:
        yield pages[["doc_id", "pageno"]].assign(text="", orientation=0, confidence=0.0)


def recognise(pages: DataFrame, hooks: Hooks) -> DataFrame:
    """(doc_id, pageno, text, orientation, confidence) by the registered engine, in batches."""
    engine = hooks.call("recognise") or null_engine
    return pages.mapInPandas(engine, PAGE_RESULT)


#: Fixed value: the text of a page that an engine gave up on.
SKIPPED_PAGE = "[skipped page]"


def after_timeouts(results: DataFrame, timed_out: Column) -> DataFrame:
    """Page results in which a page that took too long has no rotation, no confidence, and a text that
    says so; the others are as they are."""
    stand_in = {"text": F.lit(SKIPPED_PAGE), "orientation": F.lit(0), "confidence": F.lit(0.0)}
    late = F.coalesce(timed_out, F.lit(False))
    return results.select(*[F.when(late, stand_in[c]).otherwise(F.col(c)).alias(c) if c in stand_in else F.col(c) for c in results.columns])


def filtered(pages: DataFrame, hooks: Hooks, hook: str) -> DataFrame:
    """``pages`` through the first handler of an image or page filter, in batches of pandas frames of
    the same columns; without one, as they are."""
    handler = next(iter(hooks.handlers.get(hook, [])), None)
    return pages.mapInPandas(handler, pages.schema) if handler else pages


def rasterised(pages: DataFrame, hooks: Hooks) -> DataFrame:
    """``pages`` with image: what the first rasteriser makes of each batch; it is an error to have
    none, as nothing else can stand for it."""
    handler = next(iter(hooks.handlers.get("rasterise_page", [])), None)
    if handler is None:
        raise LookupError("no rasteriser is registered")
    return pages.mapInPandas(handler, StructType([*pages.schema.fields, StructField("image", BinaryType())]))


def per_document(pages: DataFrame, hooks: Hooks, hook: str, schema: str) -> DataFrame:
    """One call of an archive or optimising handler for each document, on its pages in order: a pandas
    frame in, rows of ``schema`` out. A document's pages are one task's work."""
    handler = next(iter(hooks.handlers.get(hook, [])), None)
    if handler is None:
        raise LookupError(f"no handler of {hook} is registered")
    return pages.groupBy("doc_id").applyInPandas(lambda p: handler(p.sort_values("pageno")), schema)


def checked(hooks: Hooks, options: dict) -> list[str]:
    """What the handlers of check_options object to, all of it."""
    return [problem for found in hooks.call("check_options", options) for problem in found]


def registered_options(hooks: Hooks) -> dict[str, dict]:
    """Options of all handlers by name space; a later name space does not hide an earlier one."""
    spaces: dict[str, dict] = {}
    for own in reversed(hooks.call("register_options")):
        for name, fields in own.items():
            spaces[name] = spaces.get(name, {}) | fields
    return spaces


@F.pandas_udf(BinaryType())
def deflated(data: pd.Series) -> pd.Series:
    """Bytes compressed, where that makes them smaller; otherwise as they are."""
    return data.map(lambda x: None if x is None else min(zlib.compress(bytes(x), 9), bytes(x), key=len))
