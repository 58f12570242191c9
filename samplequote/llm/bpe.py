"""Byte pair encoding of a public word-level vocabulary file.

The file's rules are followed as its library does: special strings are cut out
of the raw text, the rest is composed, its white space collapsed and its letters
lower-cased, split into pre-tokens, mapped to byte symbols, and each pre-token
is merged on its own with the end-of-word mark on its last symbol. Merging keeps
a priority queue of (rank, position) over a doubly linked list of symbols; an
entry whose pair has changed meanwhile is stale and skipped. Decoding joins the
vocabulary strings of the ids, by a space where the file names no decoder.

Texts made only of characters whose composition, lower case and class are the
same in every Unicode version (ASCII and the Latin-1 letters) take a short way;
all others go through the library's own normaliser and splitter.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

from tokenizers import Tokenizer

# The pre-token pattern of the vocabulary file over the short way's letters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")


def byte_symbols() -> list[str]:
    """One printable character for each byte: printable Latin-1 bytes stand for
    themselves, the others follow from code point 256 on."""
    shown = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Merger:
    """Merge rules and vocabulary of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ends = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[a, b] = rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s
        self.glue = " " if spec.get("decoder") is None else ""
        self.byte = byte_symbols()

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.byte[b] for b in word.encode("utf-8")]
        if not symbols:
            return []
        symbols[-1] += self.ends
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if not symbols[i] or j < 0 or self.ranks.get((symbols[i], symbols[j])) != rank:
                continue  # stale: one of the two symbols has been merged since
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := self.ranks.get((symbols[i], symbols[after[i]]))) is not None:
                    heapq.heappush(queue, (r, i))
            if (k := before[i]) >= 0 and (r := self.ranks.get((symbols[k], symbols[i]))) is not None:
                heapq.heappush(queue, (r, k))
        return [self.ids[s] for s in symbols if s and s in self.ids]

    def decode(self, ids) -> str:
        return self.glue.join(map(self.strings.__getitem__, ids))


class Memo(dict):
    """Packed ids (little-endian unsigned 32 bits) of pre-tokens met by a task.
    Emptied when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, ids_of, limit: int = 400_000):
        super().__init__()
        self.ids_of, self.limit = ids_of, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        packed = b"".join(i.to_bytes(4, "little") for i in self.ids_of(word))
        self[word] = packed
        return packed


class Encoder:
    """Whole texts to pre-tokens and to packed ids. With ``own`` the merges are
    those of ``Merger``, else the library's model is asked for each pre-token."""

    def __init__(self, path: str, own: bool = True):
        self.merger = Merger(path)
        self.library = Tokenizer.from_file(path)
        self.memo = Memo(self.merger.merge if own else self.library_ids)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.merger.special, key=len, reverse=True))) or r"(?!)")
        self.packed = {s: i.to_bytes(4, "little") for s, i in self.merger.special.items()}

    def library_ids(self, word: str) -> list[int]:
        symbols = "".join([self.merger.byte[b] for b in word.encode("utf-8")])
        return [t.id for t in self.library.model.tokenize(symbols)]

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if _PLAIN.fullmatch(text):
            return _WORD.findall(text.lower())
        clean = self.library.normalizer.normalize_str(text)
        return [_unmap(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    def parts(self, text: str):
        """Yields (pre-tokens, special string or None) from left to right."""
        at = 0
        for m in self.cut.finditer(text):
            yield self.split(text[at:m.start()]), m[0]
            at = m.end()
        yield self.split(text[at:] if at else text), None

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        out = []
        for words, special in self.parts(text):
            out.extend(map(self.memo.__getitem__, words))
            if special is not None:
                out.append(self.packed[special])
        return b"".join(out)


def _unmap(symbols: str) -> str:
    return bytes(map(_BACK.__getitem__, symbols)).decode("utf-8", "surrogateescape")


_BACK = {s: b for b, s in enumerate(byte_symbols())}


@lru_cache(maxsize=4)
def encoder(path: str, own: bool = True) -> Encoder:
    """The encoder of a file, once per Python worker."""
    return Encoder(path, own)
