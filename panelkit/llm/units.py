"""Encoding texts with a byte-level BPE of the tokenizers library, by remembered pre-tokens.

A byte-level tokenizer splits a text into pre-tokens and turns each into ids by itself. Pre-tokens
repeat, so each goes through the library's BPE model once per worker and is then remembered. No
pre-token crosses the place before a run of white space (as Unicode defines it, like the
pre-tokenizer), so long texts are cut there, and so are texts that name a special token: pieces with
such a name are left to the library as a whole.

Texts are encoded about a megabyte at a time: their bytes are cut where surely no pre-token crosses, mostly
around each one, equal chunks are found by Arrow, and only the different ones are looked up."""

from __future__ import annotations

import ctypes
import gc
import json
import re
from array import array as _packed
from collections.abc import Iterable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: The code points with the Unicode property White_Space.
SPACE = (
    "\t-\r \x85\xa0  -     　"
)
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
BEFORE_SPACE = re.compile(f"[^{SPACE}](?=[{SPACE}])").search
#: The pre-token pattern that the library's byte-level pre-tokenizer builds in, with the
#: letters first (an alternative that begins with an apostrophe begins with no letter).
PRE_TOKENS = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone, which the standard library matches in half the time.
ASCII_PRE_TOKENS = r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Bytes that a generation of remembered pre-tokens takes about at most (a worker holds two), and the
#: characters of the longest one that is remembered.
MEMO_BYTES, LONGEST = 36_000_000, 200
#: Characters that are split into pre-tokens at a time.
WINDOW = 250_000
#: Characters of texts that are encoded together.
BLOCK = 1_000_000


def _bytes(*some: int | range) -> np.ndarray:
    """A table of all bytes: whether each is among some."""
    table = np.zeros(256, bool)
    for s in some:
        table[s] = True
    return table


#: Bytes of ASCII letters, of ASCII white space, and of ASCII but for letters and digits.
LETTER = _bytes(range(65, 91), range(97, 123))
WHITE = _bytes(range(9, 14), 32)
SIGN = _bytes(range(0, 48), range(58, 65), range(91, 97), range(123, 128))
#: Bytes that surely end a character other than white space, and that surely begin one: white space beyond
#: ASCII ends with a byte from 128 on and begins with C2, E1, E2 or E3.
SOLID_END = _bytes(range(128)) & ~WHITE
SOLID_START = SOLID_END | _bytes(range(0xC3, 0xE1), range(0xE4, 256))


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Marks of the places in UTF-8 bytes before which a pre-token surely begins, so that what lies between
    two has the same pre-tokens as alone:

    - before a run of white space, and before its last character if that is a space that no end of text
      follows (it goes to what follows);
    - after a line feed that is such a run alone;
    - between a letter and a sign, and between a sign and a letter but for the apostrophe of 's."""
    marks = np.zeros(len(data), bool)
    at = np.flatnonzero(SIGN[data[1:-1]]) + 1
    before, here, after = data[at - 1], data[at], data[at + 1]
    solid, white = SOLID_END[before], WHITE[here]
    marks[at] = np.where(white, solid | ((here == 32) & SOLID_START[after]), LETTER[before])
    ends = np.where(white, (here == 10) & solid & SOLID_START[after], (here != 39) & LETTER[after])
    marks[at[ends] + 1] = True
    return marks


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: visible Latin-1 bytes as
    themselves, the others as the code points from 256 on, in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _piecewise(spec: dict) -> bool:
    """Whether pieces may be encoded alone under this tokenizer file."""
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    model = spec["model"]
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        and not any(re.search(f"[{SPACE}]", t["content"]) for t in added)
    )


class Remembered(dict):
    """Pre-token to result; computes what it does not hold.

    At the bound on its bytes what it holds becomes the older generation, whose entries return when they
    are asked for again and are forgotten at the next bound. So what occurs often stays."""

    def __init__(self, make, limit: int = MEMO_BYTES):
        self.make, self.limit = make, limit
        self.older: dict = {}
        self.bytes = 0

    def __missing__(self, token):
        found = self.older.get(token)
        if found is None:
            found = self.make(token)
            if len(token) > LONGEST:
                return found
        # The token, its result, and their place in a table that is at most half empty.
        self.bytes += getsizeof(token) + getsizeof(found) + 60
        if self.bytes > self.limit:
            self.older, self.bytes = dict(self), 0
            self.clear()
        self[token] = found
        return found


def parts(text: str) -> Iterator[str]:
    """The text in parts of about WINDOW characters, cut before white space."""
    at = 0
    while len(text) - at > WINDOW and (found := BEFORE_SPACE(text, at + WINDOW)):
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:] if at else text


class Encoder:
    """Ids of whole texts, as ``encode(text, add_special_tokens=False)`` gives them.

    A null text counts as empty. Strings of special tokens inside a text become those tokens, as
    is the library's default. Files of another kind than byte-level BPE are encoded text by text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.piecewise = _piecewise(spec)
        specials = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(specials) or r"(?!)").search
        self.letters = _byte_letters()
        self.any_pre_tokens = regex.compile(PRE_TOKENS).findall
        self.ascii_pre_tokens = re.compile(ASCII_PRE_TOKENS, re.ASCII).findall
        self.merge = self.tokenizer.model.tokenize
        self.tokens = Remembered(self._chunk)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def pre_tokens(self, text: str) -> list[str]:
        return self.ascii_pre_tokens(text) if text.isascii() else self.any_pre_tokens(text)

    def merged(self, token: str) -> list[int]:
        """Ids of one pre-token."""
        if token.isascii() and token.isprintable():
            as_letters = token.replace(" ", self.letters[32])
        else:
            as_letters = token.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        return [t.id for t in self.merge(as_letters)]

    def _pre_token(self, token: str) -> bytes:
        ids = self.merged(token)
        return ids[0].to_bytes(4, "little") if len(ids) == 1 else _packed("I", ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.removeprefix(" ").isalpha() or len(tokens := self.pre_tokens(chunk)) == 1:
            return self._pre_token(chunk)
        return b"".join(map(self.tokens.__getitem__, tokens))

    def _piece(self, piece: str) -> bytes:
        if self.special(piece):
            return self.whole(piece)
        return b"".join(map(self.tokens.__getitem__, self.pre_tokens(piece)))

    def _part(self, text: str) -> bytes:
        if self.special(text):
            return b"".join(map(self._piece, PIECES(text)))
        return self._block([text])[0]

    def _block(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        if not texts:
            return []
        # A line feed ends each text, as a chunk of its own.
        rows = [t.encode("utf-8", "replace") for t in texts]
        data = b"\n".join([*rows, b""])
        feeds = np.cumsum([len(r) + 1 for r in rows]) - 1
        starts = np.concatenate([[0], feeds[:-1] + 1])
        marks = chunk_starts(np.frombuffer(data, "u1"))
        marks[starts] = marks[feeds] = True
        edges = np.append(np.flatnonzero(marks), len(data))
        chunks = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data))
        coded = chunks.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(map(self.tokens.__getitem__, different), pa.large_binary()).take(coded.indices)
        _, offsets, body = ids.buffers()
        offsets, body = np.frombuffer(offsets, "<i8"), memoryview(body)
        first, last = (offsets[np.searchsorted(edges, x)].tolist() for x in (starts, feeds))
        return [bytes(body[a:b]) for a, b in zip(first, last)]

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in order."""
        if not self.piecewise:
            yield from (self.whole(text) if text else b"" for text in texts)
            return
        block, size = [], 0
        for text in texts:
            text = text or ""
            alone = len(text) > WINDOW or self.special(text)
            if alone or size + len(text) > BLOCK:
                yield from self._block(block)
                block, size = [], 0
            if alone:
                yield b"".join(map(self._part, parts(text)))
            else:
                block.append(text)
                size += len(text)
        yield from self._block(block)


class TokenCounter:
    """Tokens of whole texts, by vocabulary strings proven to be one token.

    ``single`` holds the strings that encode alone as one token. A pre-token among them counts
    one without any merging; only the other pre-tokens go through the library's merges."""

    def __init__(self, path: str, single: frozenset[str]):
        self.encoder = Encoder(path)
        self.single = dict.fromkeys(single, 1)
        self.merged = Remembered(lambda token: len(self.encoder.merged(token)))

    def _count(self, text: str) -> int:
        single, merged = self.single.get, self.merged
        return sum([single(t) or merged[t] for t in self.encoder.pre_tokens(text)])

    def _piece(self, piece: str) -> int:
        enc = self.encoder
        return len(enc.whole(piece)) // 4 if enc.special(piece) else self._count(piece)

    def _part(self, text: str) -> int:
        return sum(map(self._piece, PIECES(text))) if self.encoder.special(text) else self._count(text)

    def counts(self, texts: Iterable[str | None]) -> Iterator[int]:
        for text in texts:
            if not text:
                yield 0
            elif self.encoder.piecewise:
                yield sum(map(self._part, parts(text)))
            else:
                yield len(self.encoder.whole(text)) // 4


def single_token_strings(path: str) -> frozenset[str]:
    """Vocabulary strings that the tokenizer, given nothing else, encodes as exactly one token.

    Proven once, before any text is read, by encoding every string of the vocabulary. Tokens that
    are no valid UTF-8 alone cannot equal a pre-token and are left out, as are special tokens.
    Empty for tokenizers of another kind than byte-level BPE. Bounded by the vocabulary."""
    enc = Encoder(path)
    if not enc.piecewise:
        return frozenset()
    ids = enc.tokenizer.get_vocab(with_added_tokens=False).values()
    strings = (enc.tokenizer.decode([i], skip_special_tokens=False) for i in ids)
    strings = [s for s in strings if s and "�" not in s and not enc.special(s)]
    found = enc.tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, found) if len(e.ids) == 1)


_kept: dict = {}


def kept(kind, *args):
    """One instance per worker process and arguments: a worker's tasks share what it remembers."""
    key = (kind, *args)
    if key not in _kept:
        _kept[key] = kind(*args)
    return _kept[key]


def release() -> None:
    """Give up what this worker remembers. Tasks of operators that encode nothing call it first, since
    workers outlive the stage that filled them."""
    if _kept:
        _kept.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library: memory goes back when it likes
            pass
