"""Exact tokenisation with a memory of chunks that tokenise on their own.

Texts repeat words far more often than they bring new ones. Both vocabularies cut texts
before they merge, and some cuts depend on one character only; between such cuts a chunk
always gives the same ids. Each chunk is encoded by the library once and remembered.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable

#: Chunks that a worker remembers before it starts anew.
REMEMBERED = 500_000

_loaded: dict[tuple[str, str], object] = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def packed(encoding) -> bytes:
    ids = array("I", encoding.ids)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def per_worker(kind: Callable, path: str):
    """One ``kind(path)`` for each Python worker, kept for its later tasks."""
    key = (kind.__name__, path)
    if key not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]


def file_digest(path: str) -> str:
    """SHA-256 of a tokenizer file: its version, as far as counts are concerned."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordIds:
    """Ids of texts under a vocabulary that drops white space and case, as little-endian 32-bit
    bytes.

    ASCII white space always ends a token there, and no special string holds any. Special
    strings are told by case, so a text that may hold one keeps its own.
    """

    remembered = 1_500_000

    def __init__(self, path: str):
        self.tokenizer, self.known = load(path), {}

    def __call__(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8")
        words = (data if b"<|" in data else data.lower()).split()
        if new := set(words).difference(self.known):
            if len(self.known) + len(new) > self.remembered:
                self.known, new = {}, set(words)
            self.learn(new)
        return b"".join(map(self.known.__getitem__, words))

    def learn(self, words: Iterable[bytes]) -> None:
        words = list(words)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)
            self.known.update(zip(part, map(packed, found), strict=True))


class SpacedIds:
    """Ids of texts under a byte-level vocabulary that gives a word its leading space.

    A cut before a space is safe where the character before it is not white space: no token
    holds both, and what follows a text's last visible character cannot change its token.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = load(path), {}

    unsafe = re.compile(r"\s ")
    cut = re.compile(r"(?<=\S)(?= )")

    def chunks(self, text: str) -> list[str]:
        if self.unsafe.search(text):
            return self.cut.split(text)
        first, *rest = text.split(" ")
        if not first:  # a leading space belongs to the first word
            return [" " + x for x in rest]
        return [first, *[" " + x for x in rest]]

    def lookup(self, text: str | None) -> list[bytes]:
        parts = self.chunks(text or "")
        if new := set(parts).difference(self.known):
            if len(self.known) + len(new) > REMEMBERED:
                self.known, new = {}, set(parts)
            self.learn(new)
        return list(map(self.known.__getitem__, parts))

    def __call__(self, text: str | None) -> bytes:
        return b"".join(self.lookup(text))

    def learn(self, parts: Iterable[str]) -> None:
        parts = list(parts)
        for at in range(0, len(parts), 20_000):
            part = parts[at : at + 20_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, map(packed, found), strict=True))


class SpacedCounts(SpacedIds):
    """Token counts instead of ids."""

    def __call__(self, text: str | None) -> int:
        return sum(self.lookup(text))

    def learn(self, parts: Iterable[str]) -> None:
        parts = list(parts)
        for at in range(0, len(parts), 20_000):
            part = parts[at : at + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = len(e.ids)


class PlainCounts:
    """Token counts by the library alone, for any other vocabulary file."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(model.encode(text))
        else:
            tokenizer = load(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str | None) -> int:
        return self.count(text or "")


def keeps_spaces(path: str) -> bool:
    """Whether a vocabulary file is one that SpacedIds reads right: byte level, cut by the
    usual pattern, nothing normalised."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    return (
        not spec.get("normalizer")
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"])
    )


def counter(path: str):
    return per_worker(SpacedCounts if keeps_spaces(path) else PlainCounts, path)
