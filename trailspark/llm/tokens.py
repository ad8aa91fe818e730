"""Token ids of whole texts by the tokenizers library, with a memo of the ids of text pieces.

A text may be encoded piece by piece wherever the tokenizer's own splitting can't reach across the cut. That holds for
two kinds of files, told apart by their settings: word models that drop white space, cut at any of it; and byte-level
models, cut before a single space between two other characters. A text of Latin letters, digits, ASCII punctuation,
single spaces and line ends is cut finer, into the matches of the tokenizer's pattern, which repeat more often. Any
other file, and a text that holds a special token or a control character on which the libraries' notions of white space
differ, is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from tokenizers import Tokenizer

from .common import in_steps

#: Pieces that a generation of a memo remembers at most, and their characters: some 100 MB.
REMEMBERED, REMEMBERED_CHARS = 500_000, 10_000_000

_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PUNCTUATION = r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[{_LETTERS}{_PUNCTUATION}0-9 \n]*")
_WORD_MATCH = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_PUNCTUATION}]+")
_BYTE_MATCH = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_PUNCTUATION}]+|\n")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_CONTROL = re.compile("[\x1c-\x1f]")


def _shown_bytes() -> dict[int, int]:
    """The byte-level models' character for each byte: itself where it prints, else the next one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_SHOWN = _shown_bytes()


def _even(plain: str) -> bool:
    """Whether no white space of a plain text stands beside another, and no space at an end."""
    return not ("  " in plain or " \n" in plain or "\n " in plain or "\n\n" in plain or plain[:1] == " " or plain[-1:] == " ")


def _is_word_model(file: dict) -> bool:
    norm, split = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    parts = split.get("pretokenizers") or [{}, {}]
    return (
        [x.get("type") for x in norm.get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
        and norm["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
        and parts[0].get("pattern") == {"Regex": _WORD_SPLIT}
        and parts[0].get("behavior") == "Removed"
        and len(parts) == 2
        and parts[1].get("type") == "ByteLevel"
        and not parts[1].get("use_regex")
    )


def _is_byte_model(file: dict) -> bool:
    split = file.get("pre_tokenizer") or {}
    return not file.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")


class Memo:
    """Ids of pieces, in two generations: a full one grows old, and what is not asked for until the next is full goes."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def learn(self, wanted: set[str], ids: Callable[[list[str]], list[bytes]]) -> None:
        """Afterwards young holds every wanted piece."""
        new = wanted.difference(self.young)
        size = sum(map(len, new))
        if self.young and (len(self.young) + len(new) > REMEMBERED or self.chars + size > REMEMBERED_CHARS):
            self.young, self.old, self.chars = {}, self.young, 0
            new, size = wanted, sum(map(len, wanted))
        known = new.intersection(self.old)
        self.young.update((p, self.old[p]) for p in known)
        unknown = list(new.difference(known))
        self.young.update(zip(unknown, ids(unknown), strict=True))
        self.chars += size

    def clear(self) -> None:
        self.__init__()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        file = json.loads(content)
        self.whole = Tokenizer.from_str(content)
        self.words, self.bytes = _is_word_model(file), _is_byte_model(file)
        self.special = [t["content"] for t in file.get("added_tokens") or []]
        self.matches, self.pieces = Memo(), Memo()

    def forget(self) -> None:
        """Free the memos, at the end of a task."""
        self.matches.clear()
        self.pieces.clear()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _match_ids(self, matches: list[str]) -> list[bytes]:
        """The ids of matches of the pattern: what is left to do for them is the model's part."""
        tokenize = self.whole.model.tokenize
        return [array("I", [t.id for t in tokenize(m.encode().decode("latin-1").translate(_SHOWN))]).tobytes() for m in matches]

    def _cut(self, text: str) -> tuple[Memo, list[str]] | None:
        """The memo to look in and the pieces, or None if the text must stay whole."""
        if not (self.words or self.bytes) or _CONTROL.search(text) or any(s in text for s in self.special):
            return None
        plain = _PLAIN.fullmatch(text)
        if self.words:
            return (self.matches, _WORD_MATCH.findall(text.lower())) if plain else (self.pieces, text.split())
        if plain and _even(text):
            return self.matches, _BYTE_MATCH.findall(text)
        return self.pieces, _BEFORE_SPACE.split(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text; null counts as empty."""
        texts = [t or "" for t in texts]
        out = []
        for start, end in in_steps(texts, 1 << 20):
            cut = [self._cut(t) for t in texts[start:end]]
            for memo, ids in ((self.matches, self._match_ids), (self.pieces, self._ids)):
                memo.learn(set().union(*(c[1] for c in cut if c and c[0] is memo)), ids)
            out += [self._ids([t])[0] if c is None else b"".join(map(c[0].young.__getitem__, c[1])) for t, c in zip(texts[start:end], cut, strict=True)]
        return out


_encoders: dict[int, Encoder] = {}


@contextmanager
def encoder(content: str) -> Iterator[Encoder]:
    """The process's encoder for a tokenizer file's content, for a task: the last one is kept, its memos are not."""
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content)
    try:
        yield _encoders[key]
    finally:
        _encoders[key].forget()


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
