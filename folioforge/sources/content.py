"""Page content streams as tables of operators and of what they draw."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.folds import GraphicsState, multiply

#: Tokens of a content stream, by the public format.
TOKEN = re.compile(
    r"%[^\r\n]*|(\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[-+]?(?:\d+\.?\d*|\.\d+)(?![^\s()<>\[\]{}/%])|[^\s()<>\[\]{}/%]+)",
    re.S,
)
NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)\Z")
#: Operators that paint paths, show text, set ink with the number of components.
PAINTS, SHOWS = {"S", "s", "f", "F", "f*", "B", "B*", "b", "b*"}, {"Tj", "TJ", "'", '"'}
INKS = {"g": 1, "G": 1, "rg": 3, "RG": 3, "k": 4, "K": 4}
EPSILON = 1e-3


def operators(stream: str | None) -> Iterator[tuple[str, list[str]]]:
    """(operator, operands) of a content stream in order. Arrays and dictionaries are one operand;
    an inline image is one operator ``INLINE IMAGE`` with its settings; its data is not read."""
    operands, nested, text = [], 0, stream or ""
    place = 0
    while m := TOKEN.search(text, place):
        place, token = m.end(), m[1]
        if token is None:
            continue
        if token in ("[", "<<"):
            nested += 1
            operands.append(token) if nested == 1 else operands.__setitem__(-1, f"{operands[-1]} {token}")
        elif token in ("]", ">>"):
            if nested:
                operands[-1] = f"{operands[-1]} {token}"
                nested -= 1
        elif nested:
            operands[-1] = f"{operands[-1]} {token}"
        elif token[0] in "(</" or NUMBER.match(token) or token in ("true", "false", "null"):
            operands.append(token)
        elif token == "BI":
            data = re.compile(r"\bID\s").search(text, place)
            end = re.compile(r"\sEI(?![^\s])").search(text, data.end() if data else place)
            settings = text[place : data.start() if data else len(text)].split()
            place, operands = end.end() if end else len(text), []
            yield "INLINE IMAGE", settings
        else:
            yield token, operands
            operands = []


def ink_of(parts: list[float]) -> str:
    """mono, gray or color of the components of a gray, rgb or cmyk ink."""

    def gray(v: float) -> str:
        return "mono" if abs(v) <= EPSILON or abs(v - 1) <= EPSILON else "gray"

    if len(parts) == 1:
        return gray(parts[0])
    if len(parts) == 3 and max(parts) - min(parts) <= EPSILON:
        return gray(parts[0])
    if len(parts) == 4 and max(map(abs, parts[:3])) <= EPSILON:
        return gray(1 - parts[3])
    return "color"


#: Inks in rising order of what they need.
INK_ORDER = ["mono", "gray", "color"]


def markers(stream: str | None) -> tuple[list[tuple], str, str, int]:
    """What a stream draws, as (kind, name, depth, ink, matrix) in order; the highest ink it
    paints with; what is wrong with its stack; the greatest depth. Kinds are vector, text,
    inline and object (an image or form by name)."""
    state, found, most, mode, modes = GraphicsState(), [], "mono", 0, []

    def note(kind: str, name: str | None = None) -> None:
        nonlocal most
        found.append((kind, name, len(state.stack), state.ink, state.matrix))
        most = max(most, state.ink, key=INK_ORDER.index)

    for op, operands in operators(stream):
        if op == "q":
            state.push()
            modes.append(mode)
        elif op == "Q":
            state.pop()
            mode = modes.pop() if modes else mode
        elif op == "cm" and len(operands) == 6 and all(map(NUMBER.match, operands)):
            state.matrix = multiply(tuple(map(float, operands)), state.matrix)
        elif op in INKS:
            parts = [float(x) for x in operands if NUMBER.match(x)]
            state.ink = ink_of(parts) if len(parts) == INKS[op] else "color"
        elif op in ("sc", "scn", "SC", "SCN"):
            parts = [float(x) for x in operands if NUMBER.match(x)]
            state.ink = ink_of(parts) if parts and len(parts) == len(operands) else "color"
        elif op == "sh":
            state.ink = "color"
            note("vector")
        elif op == "Tr" and operands and NUMBER.match(operands[-1]):
            mode = int(float(operands[-1]))
        elif op in PAINTS:
            note("vector")
        elif op in SHOWS:
            found.append(("hidden text" if mode == 3 else "text", None, len(state.stack), state.ink, state.matrix))
        elif op == "INLINE IMAGE":
            note("inline")
        elif op == "Do" and operands:
            note("object", operands[-1].lstrip("/"))
    return found, most, state.status, state.deepest


def content_operators(pages: DataFrame, id_col: str, stream_col: str) -> DataFrame:
    """(id, place, operator, operands) of every operator of every stream, in place order."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, op, args) for i, s in zip(batch[id_col], batch[stream_col], strict=True) for n, (op, args) in enumerate(operators(s))]
            yield pd.DataFrame(rows, columns=[id_col, "place", "operator", "operands"])

    return pages.select(id_col, stream_col).mapInPandas(run, f"`{id_col}` {kind}, place int, operator string, operands array<string>")


def content_markers(pages: DataFrame, id_col: str, stream_col: str) -> DataFrame:
    """(id, place, kind, name, depth, ink, a .. f): what each stream draws, one row a mark."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, "place", "kind", "name", "depth", "ink", *"abcdef"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (i, n, k, name, depth, ink, *m)
                for i, s in zip(batch[id_col], batch[stream_col], strict=True)
                for n, (k, name, depth, ink, m) in enumerate(markers(s)[0])
            ]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(id_col, stream_col).mapInPandas(
        run, f"`{id_col}` {kind}, place int, kind string, name string, depth int, ink string, " + ", ".join(f"{x} double" for x in "abcdef")
    )


def page_scan(pages: DataFrame, id_col: str, stream_col: str) -> DataFrame:
    """(id, has_text, has_vector, n_objects, n_inline, ink, deepest, status) of every page: one row
    for each stream, so a document's pages are dealt over tasks like any rows."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, "has_text", "has_vector", "n_objects", "n_inline", "ink", "deepest", "status"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, s in zip(batch[id_col], batch[stream_col], strict=True):
                found, ink, status, deepest = markers(s)
                kinds = [k for k, *_ in found]
                text = any(k in ("text", "hidden text") for k in kinds)
                rows.append((i, text, "vector" in kinds, kinds.count("object"), kinds.count("inline"), ink, deepest, status))
            yield pd.DataFrame(rows, columns=names)

    return pages.select(id_col, stream_col).mapInPandas(
        run, f"`{id_col}` {kind}, has_text boolean, has_vector boolean, n_objects int, n_inline int, ink string, deepest int, status string"
    )
