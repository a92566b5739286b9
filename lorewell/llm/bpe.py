"""BPE from a tokenizer file of the tokenizers library, with ids equal to that library's.

Two engines read the file's vocabulary and merges:

* ``ByteBpe``: byte-level BPE without end-of-word marks.
* ``WordBpe``: BPE with end-of-word marks; lower case, white space dropped.

Texts are split as the file's pre-tokenizer says; the pieces are merged by a byte-pair engine whose ranks are the
file's merge order. A piece longer than ``LONG_PIECE`` is encoded by tree concatenation: its halves are encoded on
their own (leaves side by side in threads), then a window around each join is encoded again and grows until its
first token equals the left half's token there and its last token the right half's. A token list whose adjacent
pairs are each what BPE makes of their two texts is what BPE makes of the whole, so agreement on both sides makes
the join exact.

Texts with characters outside a plain set (say combining marks, whose normal form depends on their neighbours) are
encoded by the tokenizers library itself, or, if they hold a long run without white space, normalised and split by it
and merged here, so that long pieces of any script are concatenated; ids are the same either way.
"""

from __future__ import annotations

import json
import re
from array import array
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Characters of an unsplit piece beyond which it is encoded by tree concatenation, of its leaves, and of the first window on either side of a join.
LONG_PIECE, LEAF, WINDOW = 4096, 2048, 4
#: The pre-tokenizers' patterns (fixed values of the tokenizer files).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters on which this module's splitting and lower-casing provably agree with the library's.
_PLAIN = "\t\n\rŒœ–—‘’‚‛“”„†‡•…€" + "".join(map(chr, [*range(32, 127), *range(161, 173), *range(174, 256)]))
_OTHER = re.compile(f"[^{re.escape(_PLAIN)}]")
_LONG_RUN = regex.compile(r"\S{%d}" % LONG_PIECE)


def byte_letters() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class _Engine:
    """Merges of one file as ranks over bytes; ``mark`` is the byte put after a word's last one."""

    def __init__(self, path: str, mark: bytes):
        spec = json.load(open(path, encoding="utf-8"))
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        back = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        self.mark, self._letters = mark, {ord(c): b[0] for c, b in back.items()}
        self.ranks: dict[bytes, int] = {}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                marked = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
                body = token[: -len(self.suffix)] if marked else token
                self.ranks[b"".join(back[c] for c in body) + mark * marked] = i
        self.special = special
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = max([*self.ranks.values(), *special.values()]) + 1
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def piece(self, data: bytes) -> list[int]:
        return self.core._core_bpe.encode_single_piece(data)

    def _by_library(self, text: str) -> np.ndarray:
        """A text that the library encodes, or normalises and splits if a piece may be long."""
        if _LONG_RUN.search(text) is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        ids: list[int] = []
        at, norm = 0, self.library.normalizer
        for m in [*(self._special.finditer(text) if self._special else ()), None]:
            part = text[at : m.start() if m else len(text)]
            for p, _ in self.library.pre_tokenizer.pre_tokenize_str(norm.normalize_str(part) if norm else part):
                # pieces come in the letters of bytes, all below 512
                data = p.translate(self._letters).encode("latin-1") + self.mark
                ids += self.concatenated(data) if len(data) > LONG_PIECE else self.piece(data)
            if m:
                ids.append(self.special[m[0]])
                at = m.end()
        return np.array(ids, np.uint32)

    def concatenated(self, data: bytes, leaf: int = LEAF) -> list[int]:
        """A long piece by tree concatenation."""
        # halves, quarters, ... down to the leaves
        cuts = [0, len(data)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
        with ThreadPoolExecutor(2) as pool:
            parts = list(pool.map(lambda ab: self.piece(data[ab[0] : ab[1]]), zip(cuts, cuts[1:], strict=False)))
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        n = WINDOW
        while True:
            a, b = left[-n:], right[:n]
            made = self.piece(b"".join(self.bytes_of[i] for i in a + b))
            all_left, all_right = len(a) == len(left), len(b) == len(right)
            if (all_left or made[0] == a[0]) and (all_right or made[-1] == b[-1]) and (len(made) > 1 or (all_left and all_right)):
                return left[: len(left) - len(a)] + made + right[len(b) :]
            n *= 2


class ByteBpe(_Engine):
    def __init__(self, path: str):
        super().__init__(path, b"")
        self.core = tiktoken.Encoding("byte", pat_str=BYTE_PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self._split = regex.compile(BYTE_PATTERN)

    def encode(self, text: str) -> np.ndarray:
        if _OTHER.search(text):
            return self._by_library(text)
        if _LONG_RUN.search(text) is None:
            return np.frombuffer(self.core._core_bpe.encode_to_tiktoken_buffer(text, set(self.special)), np.uint32)
        ids: list[int] = []
        at = 0
        for m in [*(self._special.finditer(text) if self._special else ()), None]:
            for p in self._split.findall(text[at : m.start() if m else len(text)]):
                ids += self.concatenated(p.encode()) if len(p) > LONG_PIECE else self.piece(p.encode())
            if m:
                ids.append(self.special[m[0]])
                at = m.end()
        return np.array(ids, np.uint32)


class _Words(dict):
    """Ids of words met so far, as bytes; emptied when full."""

    def __init__(self, bpe: _Engine, most: int = 300_000):
        super().__init__()
        self.bpe, self.most, self.piece = bpe, most, bpe.core._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        data = word.encode() + b" "
        if len(word) > LONG_PIECE:
            return array("I", self.bpe.concatenated(data)).tobytes()
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = array("I", self.piece(data)).tobytes()
        return ids


class _Chunks(dict):
    """Ids of stretches without white space met so far, which no piece crosses; long ones are not kept."""

    def __init__(self, words: _Words, split: regex.Pattern):
        super().__init__()
        self.words, self.pieces = words, split.findall

    def __missing__(self, chunk: str) -> bytes:
        words = self.words
        if chunk.isalpha():
            ids = words[chunk]
        elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            ids = words[chunk[:-1]] + words[chunk[-1]]
        else:
            ids = b"".join([words[p] for p in self.pieces(chunk)])
        if len(chunk) <= 64:
            if len(self) >= words.most:
                self.clear()
            self[chunk] = ids
        return ids


class WordBpe(_Engine):
    """The mark is a space, which no piece holds: a word is its bytes and the mark, "w</w>" a token that ends in it.
    Words and stretches between white space repeat, so their ids are kept."""

    def __init__(self, path: str):
        super().__init__(path, b" ")
        self.core = tiktoken.Encoding("word", pat_str="[^ ]+ ", mergeable_ranks=self.ranks, special_tokens={})
        self._split = regex.compile(WORD_PATTERN)
        self._chunks = _Chunks(_Words(self), self._split)

    def encode(self, text: str) -> np.ndarray:
        if _OTHER.search(text):
            return self._by_library(text)
        if self._special and "<|" in text and self._special.search(text):
            parts, at = [], 0
            for m in self._special.finditer(text):
                parts += [self._ordinary(text[at : m.start()]), np.array([self.special[m[0]]], np.uint32)]
                at = m.end()
            return np.concatenate([*parts, self._ordinary(text[at:])])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> np.ndarray:
        chunks = self._chunks
        return np.frombuffer(b"".join([chunks[c] for c in text.lower().split()]), np.uint32)


@lru_cache(maxsize=4)
def engine(path: str) -> ByteBpe | WordBpe:
    """The engine for a tokenizer file, kept for the life of a worker process."""
    spec = json.load(open(path, encoding="utf-8"))
    return WordBpe(path) if spec["model"].get("end_of_word_suffix") else ByteBpe(path)


@lru_cache(maxsize=4)
def decoder(path: str):
    """decode(ids) as the library does with skip_special_tokens=False."""
    spec = json.load(open(path, encoding="utf-8"))
    library = engine(path).library
    if spec.get("decoder") is not None:
        return lambda ids: library.decode(ids.tolist() if hasattr(ids, "tolist") else list(ids), skip_special_tokens=False)
    # without a decoder the library joins the token strings by single spaces
    names = [library.id_to_token(i) for i in range(engine(path).size)]
    joined = np.array([n if n is not None else "" for n in names], dtype=object)
    known = np.array([n is not None for n in names])

    def decode(ids) -> str:
        ids = np.asarray(ids, np.int64)
        return " ".join(joined[ids[known[ids]]].tolist())

    return decode
