"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Training happens on a bounded, documented sample of labelled documents. Their words become
labelled tokens by weak supervision: in a document labelled toxic, a word is toxic if it or
one of its beginnings occurs far more often in toxic documents than in others. The chain has
two states (toxic, other), emissions by word and beginnings, and learned transitions. Scoring
runs forward-backward over every word of every text; marginals give spans and, through a
small logistic model of their sum, density and maximum, the document's score.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices_by_bytes
from .tokenize import REMEMBERED

#: Labelled documents that the model is fitted on, at most, and bytes of their texts together.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 24_000_000
#: Words of a chain that are worked on at once, and the words before and after them that are
#: run through first; the chain forgets its start long before.
STRETCH, LEAD = 256, 48
LIMIT = 30.0
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[str]:
    """What the emission of a word is a sum over: the word, and its beginnings."""
    w = EDGE.sub("", word.lower())
    return [f"={w}", *[f"^{w[:k]}" for k in range(3, 7) if len(w) >= k]]


@dataclass
class Chain:
    """Log-odds of toxic against other: emission weights, and potentials of the transitions."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    start: float = 0.0
    # log potentials: other-other, other-toxic, toxic-other, toxic-toxic
    moves: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0, 0.0]))
    document: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def _messages(e: np.ndarray, first: np.ndarray, last: np.ndarray, start: float, moves: np.ndarray):
    """Forward and backward log-odds for chains in columns (step, chain)."""
    oo, ot, to, tt = np.exp(moves)
    steps = len(e)
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0] + start
    for t in range(1, steps):
        x = np.exp(np.clip(a[t - 1], -LIMIT, LIMIT))
        a[t] = e[t] + np.where(first[t], start, np.log((x * tt + ot) / (x * to + oo)))
    for t in range(steps - 2, -1, -1):
        x = np.exp(np.clip(e[t + 1] + b[t + 1], -LIMIT, LIMIT))
        b[t] = np.where(last[t], 0.0, np.log((tt * x + to) / (ot * x + oo)))
    return a, b


def marginals(e: np.ndarray, sizes: np.ndarray, start: float, moves: np.ndarray) -> np.ndarray:
    """The probability of toxic for every word of documents that lie one after another in
    ``e`` with the given numbers of words."""
    n = len(e)
    if not n:
        return np.empty(0)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    ends = np.cumsum(sizes[sizes > 0])
    first[np.concatenate(([0], ends[:-1]))] = True
    last[ends - 1] = True
    begins = np.arange(0, n, STRETCH)
    place = begins[None, :] + np.arange(-LEAD, STRETCH + LEAD)[:, None]
    outside, place = (place < 0) | (place >= n), np.clip(place, 0, n - 1)
    a, b = _messages(
        np.where(outside, 0.0, e[place]), np.where(outside, False, first[place]),
        np.where(outside, True, last[place]), start, moves,
    )
    odds = (a + b)[LEAD : LEAD + STRETCH].T.reshape(-1)[:n]
    return 1.0 / (1.0 + np.exp(-np.clip(odds, -LIMIT, LIMIT)))


def label_tokens(texts: list[list[str]], toxic: np.ndarray, floor: int = 3, ratio: float = 8.0) -> list[np.ndarray]:
    """0/1 for each word. In toxic documents a word is 1 if some feature of it occurs in at
    least ``floor`` toxic documents and ``ratio`` times as often there as in others."""
    inside, outside = Counter(), Counter()
    for words, label in zip(texts, toxic, strict=True):
        (inside if label else outside).update({f for w in set(words) for f in features(w)})
    a, b = max(1, int(toxic.sum())), max(1, int(len(toxic) - toxic.sum()))
    strong = {f for f, k in inside.items() if k >= floor and (k + 0.5) / a >= ratio * (outside[f] + 0.5) / b}
    known: dict[str, bool] = {}

    def is_toxic(w: str) -> bool:
        if w not in known:
            known[w] = any(f in strong for f in features(w))
        return known[w]

    return [np.array([is_toxic(w) for w in words] if label else [False] * len(words), float) for words, label in zip(texts, toxic, strict=True)]


def train(texts: list[str], toxic: list[int], odds: float | None = None, rounds: int = 60, l2: float = 1e-3) -> Chain:
    """The chain and document model of labelled texts. ``odds`` are the log-odds of toxic where
    the texts come from, if they were drawn by label. Without both labels among the texts the
    prior alone is learned."""
    y = np.array(toxic, float)
    model = Chain()
    drawn = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    odds = drawn if odds is None else odds
    model.document[0] = odds
    if not 0 < y.sum() < len(y):
        return model
    words = [list(map(sys.intern, t.split())) for t in texts]
    labels = label_tokens(words, y)
    vocabulary: dict[str, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for ws in words for w in ws), np.int64)
    gold = np.concatenate([*labels, np.empty(0)])
    sizes = np.array([len(w) for w in words])
    names: dict[str, int] = {}
    pairs = [(k, names.setdefault(f, len(names))) for w, k in vocabulary.items() for f in features(w)]
    of_word, of_feature = np.array(pairs, np.int64).reshape(-1, 2).T
    # documents are cut into stretches; one without a toxic word in reach counts as drawn
    pad = (-len(ids)) % STRETCH
    first = np.zeros(len(ids) + pad, bool)
    last = np.zeros(len(ids) + pad, bool)
    ends = np.cumsum(sizes[sizes > 0])
    first[np.concatenate(([0], ends[:-1]))] = True
    last[ends - 1] = True
    shape = lambda x, fill: np.append(x, np.full(pad, fill, x.dtype)).reshape(-1, STRETCH).T
    token, truth = shape(ids, 0), shape(gold, 0.0)
    real = shape(np.ones(len(ids)), 0.0)
    first, last = first.reshape(-1, STRETCH).T, last.reshape(-1, STRETCH).T
    n = real.sum()
    theta = np.zeros(len(names) + 6)
    theta[-6:] = [-4.0, 0.0, *model.moves]
    speed = np.full(len(theta), 1e-8)
    for _ in range(rounds):
        bias, start, moves = theta[-6], theta[-5], theta[-4:]
        score = bias + np.bincount(of_word, theta[of_feature], len(vocabulary))
        e = np.where(real > 0, score[token], 0.0)
        a, b = _messages(e, first, last, start, moves)
        p = 1.0 / (1.0 + np.exp(-np.clip(a + b, -LIMIT, LIMIT)))
        error = (p - truth) * real
        per_word = np.bincount(token.ravel(), error.ravel(), len(vocabulary))
        gradient = np.zeros_like(theta)
        gradient[: len(names)] = np.bincount(of_feature, per_word[of_word], len(names))
        gradient[-6], gradient[-5] = error.sum(), error[first].sum()
        linked = (real[1:] > 0) & ~first[1:]
        x, z = np.exp(np.clip(a[:-1], -LIMIT, LIMIT)), np.exp(np.clip(e[1:] + b[1:], -LIMIT, LIMIT))
        joint = np.stack([np.exp(m) * v for m, v in zip(moves, (np.ones_like(x), z, x, x * z), strict=True)])
        joint /= joint.sum(0)
        was, now = truth[:-1], truth[1:]
        seen = np.stack([(1 - was) * (1 - now), (1 - was) * now, was * (1 - now), was * now])
        gradient[-4:] = ((joint - seen) * linked).sum((1, 2))
        gradient = gradient / n * 1000 + l2 * theta
        speed += gradient**2
        theta -= 0.5 * gradient / np.sqrt(speed)
    model.bias, model.start, model.moves = theta[-6], theta[-5], theta[-4:].copy()
    model.weights = {f: w for f, k in names.items() if abs(w := float(theta[k])) > 1e-3}
    score = model.bias + np.bincount(of_word, theta[of_feature], len(vocabulary))
    p = marginals(score[ids], sizes, model.start, model.moves)
    model.document = _logistic(document_features(p, sizes), y)
    model.document[0] += odds - drawn
    return model


def document_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document: 1, log(1 + expected toxic words), log(1 + their per cent), the
    largest marginal."""
    total, most = np.zeros(len(sizes)), np.zeros(len(sizes))
    filled = np.flatnonzero(sizes)
    if len(filled):
        at = np.concatenate(([0], np.cumsum(sizes[filled])[:-1]))
        total[filled], most[filled] = np.add.reduceat(p, at), np.maximum.reduceat(p, at)
    return np.stack([np.ones(len(sizes)), np.log1p(total), np.log1p(100 * total / np.maximum(sizes, 1)), most], 1)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -LIMIT, LIMIT)))
        ridge = l2 * np.array([0.0] + [1.0] * (len(w) - 1))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(
    docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int, id_col: str, text_col: str, label_col: str
) -> tuple[DataFrame, float]:
    """At most ``rows`` labelled texts of the training folds, of at most ``most_bytes`` together,
    drawn by a hash of the id, two fifths of them toxic where there are as many; and the
    log-odds of toxic among all labels there. An id with several rows gives its least text. Folds:
    crc32 of the id as text, mod 5; remainder 0 is held out."""
    spark = docs.sparkSession
    fold = F.crc32(F.col(id_col).cast("string")) % 5
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold != 0))
    known = known.groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    odds = np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    order = F.xxhash64(id_col)
    first = lambda label, n: known.where(F.col("_label") == label).orderBy(order, id_col).limit(n)
    toxic = min(counts.get(1, 0), rows * 2 // 5)
    drawn = first(1, toxic).unionByName(first(0, rows - toxic))  # a bounded table
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(id_col, text.alias("text")).join(F.broadcast(drawn), id_col)
    texts = materialise(texts.groupBy(F.col(id_col).alias("id"), "_label").agg(F.min("text").alias("text")), "labelled")
    # one row for each id drawn: what fits into the bytes, in the order of the draw
    sizes = texts.select("id", F.xxhash64("id").alias("h"), F.octet_length("text").alias("n")).collect()
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["id"])):
        if total + r["n"] <= most_bytes:
            chosen.append((r["id"],))
            total += r["n"]
    ids = spark.createDataFrame(chosen, texts.select("id").schema)
    return texts.join(F.broadcast(ids), "id"), odds


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    with_spans: bool = False,
) -> DataFrame:
    """(id, held_out, score, predicted, n_toxic[, spans]) for every row of ``docs``.

    score is the probability of label 1, from the text alone; predicted is 1 from 0.5 on.
    n_toxic is the expected number of toxic words; spans (start, length, marginal) are the
    words with a marginal of 0.5 or more, in code points. Null, empty and blank texts have no
    words and get the score of a document without toxic words. A null id is held out of
    nothing: held_out is false. Without labels of both kinds every score is the share of
    toxic ones (0.5 without any). The model is fitted on at most ``sample_rows`` labelled texts
    of the training folds, of at most ``sample_bytes`` together, one for an id; the rest covers
    every row whole, very long texts in stretches. Repeated rows give repeated results, other
    columns are not read, an empty table gives none.
    """
    drawn, odds = training_sample(docs, labels, sample_rows, sample_bytes, id_col, text_col, label_col)
    sample = sorted((r["id"], r["text"], r["_label"]) for r in drawn.collect())
    model = train([t for _, t, _ in sample], [x for _, _, x in sample], odds)
    del sample
    kind = docs.schema[id_col].dataType.simpleString()
    span_type = "array<struct<start:int,length:int,marginal:double>>"
    names = [id_col, "score", "n_toxic", *["spans"] * with_spans]
    schema = f"`{id_col}` {kind}, score double, n_toxic double" + f", spans {span_type}" * with_spans
    known: dict[str, float] = {}

    def spans_of(text: str, p: np.ndarray) -> list[dict]:
        at = np.flatnonzero(p >= 0.5)
        if not len(at):
            return []
        places = [m.span() for m in re.finditer(r"\S+", text)] if len(at) else []
        return [{"start": places[k][0], "length": places[k][1] - places[k][0], "marginal": float(p[k])} for k in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                words = [t.split() for t in texts]
                for ws in words:
                    if new := set(ws).difference(known):
                        if len(known) + len(new) > REMEMBERED:
                            known.clear()
                            new = {w for x in words for w in x}
                        known.update((w, model.emission(w)) for w in new)
                sizes = np.array([len(w) for w in words])
                e = np.fromiter((known[w] for ws in words for w in ws), float, int(sizes.sum()))
                p = marginals(e, sizes, model.start, model.moves)
                x = document_features(p, sizes)
                score = 1.0 / (1.0 + np.exp(-np.clip(x @ model.document, -LIMIT, LIMIT)))
                columns = [batch.column(0), pa.array(score), pa.array(np.expm1(x[:, 1]))]
                if with_spans:
                    cuts = np.split(p, np.cumsum(sizes)[:-1])
                    columns.append(pa.array([spans_of(t, q) for t, q in zip(texts, cuts, strict=True)], _SPANS))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    scored = docs.select(id_col, text_col).mapInArrow(run, schema)
    return scored.select(
        id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic",
        *["spans"] * with_spans,
    )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("marginal", pa.float64())]))
