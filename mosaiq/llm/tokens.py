"""Exact tokenisation with the tokenizers library behind bounded word caches.

Byte-pair merges never cross a pre-token, so a text's ids are its words' ids joined. A worker
process keeps the ids of words it has met; the library's model runs once for a new word. When
a cache is full, new words are encoded and not kept, so memory is bounded and the result the
same. Strings of special tokens are ordinary text. Texts in which white space follows white
space, or that hold characters whose classes differ between the libraries, take a slower path.
"""

from __future__ import annotations

import functools
import json
import re

CHUNK_ENTRIES = 600_000
PIECE_ENTRIES = 300_000
LONGEST_KEY = 64

_ADJACENT = re.compile(r"\s\s")
_DOUBTFUL = "\x1c\x1d\x1e\x1f"
_MARKS = frozenset(".,;:!?")
_BEYOND_LATIN1 = re.compile("[^\x00-\x84\x86-\x9f\xa1-\xff]")


def _doubtful(text: str) -> bool:
    return any(c in text for c in _DOUBTFUL)


@functools.cache
def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(own)))}


class _Pieces(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize, self.alphabet = tokenizer.model.tokenize, _byte_alphabet()
        self.packed = [k.to_bytes(4, "little") for k in range(max(tokenizer.get_vocab().values()) + 1)]

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # of these the space alone does not stand for itself
            mapped = piece.replace(" ", "\u0120")
        else:
            mapped = piece.encode().decode("latin1").translate(self.alphabet)
        packed = self.packed
        ids = b"".join([packed[t.id] for t in self.tokenize(mapped)])
        if len(self) < PIECE_ENTRIES and len(piece) <= LONGEST_KEY:
            self[piece] = ids
        return ids


class _AdjacentSpace(Exception):
    """White space follows white space."""


class _Chunks(dict):
    """White-space-free run -> ids; ``encode`` turns a run that is not known yet into ids."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(self) < CHUNK_ENTRIES and len(chunk) <= LONGEST_KEY:
            self[chunk] = ids
        return ids


class TextEncoder:
    """``encode(text)`` gives the ids of a whole text, 4 bytes each, as the library gives them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        self.pieces = _Pieces(self.tokenizer)
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]:
            import public_tokenizers

            self.pattern = regex.compile(public_tokenizers.PATTERN)
            self.chunks = _Chunks(self._spaced_chunk)
            self.encode = self._encode_spaced
        elif pre["type"] == "Sequence" and "Lowercase" in str(spec["normalizer"]):
            self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
            self.chunks = _Chunks(self._lower_chunk)
            self.encode = self._encode_lower
        else:
            self.encode = self._whole

    def _whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _spaced_chunk(self, chunk: str) -> bytes:
        """Of what lies between single spaces, with the space or new line before it."""
        body, end = chunk[:-1], chunk[-1:]
        if body.isascii() and body.isalpha():
            if end in _MARKS:
                return self.pieces[" " + body] + self.pieces[end]
            if end.isascii() and end.isalpha():
                return self.pieces[" " + chunk]
        inner = chunk.removeprefix("\n")
        if not inner or inner[0].isspace() or end.isspace() or _ADJACENT.search(inner):
            raise _AdjacentSpace
        return self._split(chunk if inner is not chunk else " " + chunk)

    def _encode_spaced(self, text: str) -> bytes:
        if _doubtful(text):
            return self._whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        if first[-1:].isspace() or _ADJACENT.search(first):
            return self._split(text)
        # a space or new line at the end stands alone
        last = rest.pop() or " " if rest and rest[-1] in ("", "\n") else ""
        try:
            return self._split(first) + b"".join(map(self.chunks.__getitem__, rest)) + self._split(last)
        except _AdjacentSpace:
            return self._split(text)

    def _lower_chunk(self, chunk: str) -> bytes:
        return self._whole(chunk) if _BEYOND_LATIN1.search(chunk) else self._split(chunk.lower())

    def _encode_lower(self, text: str) -> bytes:
        if _doubtful(text):
            return self._whole(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder a worker process and file."""
    return TextEncoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
