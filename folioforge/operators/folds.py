"""Ordered folds over the rows of a key with bounded memory.

Some machines need their whole past: a stack of matrices, a window of messages. Their rows are
dealt by key and sorted within partitions, and a task runs through them once, holding the state
of one key; nothing is collected into arrays, and time is linear in the rows. A key's rows are
one sequence, so they are one task's work whatever the cluster; other keys are not held up.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Nested states at which a reader is warned, and beyond which it fails.
STACK_WARNS, STACK_FAILS = 32, 128
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def fold_sorted(table: DataFrame, keys: list[str], order: list[str], machine: Callable[[], Callable[[tuple], list[tuple]]], schema: str) -> DataFrame:
    """Rows that a machine gives out, run afresh over the sorted rows of each key.

    ``machine()`` makes a state: a function that takes a row (a tuple in the order of the columns)
    and returns rows of ``schema``; it is called with None once the key is done.
    """
    at = [table.columns.index(k) for k in keys]
    names = [x.strip().split()[0].strip("`") for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                own = tuple(row[i] for i in at)
                if state is None or own != key:
                    if state is not None:
                        out += state(None)
                    key, state = own, machine()
                out += state(row)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if state is not None:
            out += state(None)
        if out:
            yield pd.DataFrame(out, columns=names)

    return table.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def multiply(m: tuple, n: tuple) -> tuple:
    """The map that goes through ``m``, then through ``n``."""
    return (
        m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5],
    )


class GraphicsState:
    """Matrix and ink in force, and the states that are put aside. Depth counts every state that
    is put aside; taking one back where there is none is noted and changes nothing."""

    def __init__(self) -> None:
        self.matrix, self.ink, self.stack, self.deepest, self.underflow = IDENTITY, "mono", [], 0, False

    def push(self) -> None:
        self.stack.append((self.matrix, self.ink))
        self.deepest = max(self.deepest, len(self.stack))

    def pop(self) -> None:
        if self.stack:
            self.matrix, self.ink = self.stack.pop()
        else:
            self.underflow = True

    @property
    def status(self) -> str:
        """What a reader says of the nesting, the gravest first; empty if nothing."""
        said = ["stack overflow"] * (self.deepest > STACK_FAILS) + ["deep stack"] * (self.deepest > STACK_WARNS)
        return ", ".join(said + ["stack underflow"] * self.underflow)


def graphics_states(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, draws, deepest, status, a .. f): for each key how many draws its operators make, the
    greatest depth of the stack, what is wrong with it, and the matrix of the last draw.

    ``table`` has op (push, pop, move, draw, other) and matrix columns a .. f for moves. Operators
    beyond the limits still count: every push has its own pop.
    """
    fields = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    columns = [*keys, *[o for o in order if o not in keys], "op", *"abcdef"]
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", draws long, deepest int, status string, " + ", ".join(f"{x} double" for x in "abcdef")
    op_at = columns.index("op")

    def machine() -> Callable[[tuple | None], list[tuple]]:
        state, seen = GraphicsState(), {"n": 0, "last": (None,) * 6, "key": ()}

        def step(row: tuple | None) -> list[tuple]:
            if row is None:
                return [(*seen["key"], seen["n"], state.deepest, state.status, *seen["last"])]
            seen["key"], op = row[: len(keys)], row[op_at]
            if op == "push":
                state.push()
            elif op == "pop":
                state.pop()
            elif op == "move":
                state.matrix = multiply(row[op_at + 1 :], state.matrix)
            elif op == "draw":
                seen["n"] += 1
                seen["last"] = state.matrix
            return []

        return step

    return fold_sorted(table.select(*columns), keys, order, machine, schema)


def shown_messages(table: DataFrame, key: str, order: list[str], message: str, window: int = 5) -> DataFrame:
    """(key, place, message): a log as it is shown, numbered from 1. A message among the last
    ``window`` shown is held back; the next new one follows a note of how many were, and the
    window starts anew. Messages still held at the end leave no note."""
    fields = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    columns = [key, *[o for o in order if o not in (key, message)], message]

    def machine() -> Callable[[tuple | None], list[tuple]]:
        recent, state = deque(maxlen=window), {"held": 0, "place": 0}

        def show(k, text: str) -> tuple:
            state["place"] += 1
            return (k, state["place"], text)

        def step(row: tuple | None) -> list[tuple]:
            if row is None:
                return []
            text, out = row[-1], []
            if text in recent:
                state["held"] += 1
                return out
            if state["held"]:
                out.append(show(row[0], f"(suppressed {state['held']} repeated lines)"))
                recent.clear()
                state["held"] = 0
            recent.append(text)
            return [*out, show(row[0], text)]

        return step

    return fold_sorted(table.select(*columns), [key], order, machine, f"`{key}` {fields[key]}, place long, message string")
