"""Token ids of whole texts by a public tokenizer file, one cached encoding for each distinct word."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Unicode white space, as the tokenizers' own patterns see it (fixed values).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Latin letters without case or composition surprises (fixed values).
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# What may follow a run of them for its end to be a split of the tokenizer as well.
EDGE = r"(?=[\x00-@\[-`{-\x7f]|\Z)"
#: Distinct pieces that a worker remembers, the longest of them, and characters of texts that are split at once.
CACHE_PIECES, CACHE_CHARS, GROUP_CHARS = 500_000, 64, 1 << 19
#: Plain words that are encoded as one text.
JOINED = 512
#: Characters of texts that the byte-level kind splits at once.
SPLIT_CHARS = 1 << 23
# White space outside ASCII: the bytes before the last one, and the last ones.
FAR_WS = [(b"\xc2", b"\x85\xa0"), (b"\xe1\x9a", b"\x80"), (b"\xe2\x80", b"\x80\x81\x82\x83\x84\x85\x86\x87\x88\x89\x8a\xa8\xa9\xaf"), (b"\xe2\x81", b"\x9f"), (b"\xe3\x80", b"\x80")]
# Kinds of bytes: other ASCII, ASCII letters, white space, parts of longer characters.
OTHER, LETTER, SPACE, LONG = range(4)
KINDS = np.full(256, LONG, np.uint8)
KINDS[:128] = [SPACE if c in b"\t\n\v\f\r " else LETTER if chr(c).isalpha() else OTHER for c in range(128)]
# The byte-level alphabet: a printable character for each byte.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: b for b in _OWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _OWN)}


def piece_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces of UTF-8 texts begin; texts are the offsets of the texts in data and their end.

    A piece begins with each text, with white space after a word, with the last white space character
    before a word (the byte-level kind keeps a space before its word), with a word after other white
    space than a space, and with an ASCII sign after a Latin letter.
    """
    kind = KINDS[data]
    space, letter = kind == SPACE, kind == LETTER
    at = np.flatnonzero(data[:-1] == 0xC3) + 1  # À to ÿ, but for two signs
    letter[at[(data[at] != 0x97) & (data[at] != 0xB7)]] = True
    for first, lasts in FAR_WS:
        at = np.flatnonzero(data[: -len(first)] == first[0])
        for k, byte in enumerate(first):
            at = at[data[at + k] == byte]
        at = at[np.isin(data[at + len(first)], list(lasts))]
        for k in range(len(first) + 1):
            space[at + k] = True
    start = np.zeros(len(data), bool)
    before, after = space[:-1], space[1:]
    ends = before > after
    start[1:] = (after > before) | (letter[:-1] & (kind[1:] == OTHER)) | (ends & (data[:-1] != 0x20))
    last = np.flatnonzero(ends)
    last = last[~np.isin(last + 1, texts)]
    for _ in range(2):  # to the first byte of the character
        last = last - (data[last] & 0xC0 == 0x80)
    start[last] = True
    start[texts[texts < len(data)]] = True
    return np.flatnonzero(start)


class WordEncoder:
    """Encodes texts piecewise: the pieces end where the tokenizer itself always splits a text.

    The tokenizer never merges across these places, so the joined ids equal those of the whole text.
    Each distinct piece goes through the tokenizers library once and is then looked up. Plain words
    among the new ones go straight to the library's model, whose input they are as they stand
    (byte-level kind), or through the library many at a time, told apart again by the ids that only
    end a word (word-end kind). As the library does by default, the strings of special tokens are cut
    out of a text first and become their ids. The byte-level kind splits many texts by their bytes
    at once and looks up each distinct piece of them once; only texts with such strings go by the pattern.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.around = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.spaced = self.tok.normalizer is None  # the byte-level kind keeps a word's space
        word = f" ?[{LETTERS}]+{EDGE}| ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+" if self.spaced else f"[{LETTERS}]+{EDGE}|[^{WS}]+"
        self.pieces = re.compile(word).findall
        self.plain = re.compile(f"{' ?' if self.spaced else ''}[{LETTERS}]+").fullmatch
        vocabulary = self.tok.get_vocab()
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.edge[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        many, most = (self._by_bytes, SPLIT_CHARS) if self.spaced else (self._by_pattern, GROUP_CHARS)
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= most:
                out += many(held)
                held, size = [], 0
        return out + many(held) if held else out

    def _by_bytes(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.string())
        odd = np.zeros(len(texts), bool)
        for t in self.special:
            odd |= pc.match_substring(column, t).to_numpy(zero_copy_only=False)
        if odd.any():
            column = pc.replace_with_mask(column, pa.array(odd), "")
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[: len(texts) + 1]
        out = [b""] * len(texts)
        if ends[-1:].any():
            starts = piece_starts(np.frombuffer(data, np.uint8)[: ends[-1]], ends)
            cuts = np.append(starts, ends[-1]).astype(np.int32)
            pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), data).dictionary_encode()
            ids = pa.array(self._ids(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
            _, offsets, data = ids.buffers()
            cut = np.frombuffer(offsets, np.int64)[np.searchsorted(starts, ends)].tolist()
            out = [data[a:z].to_pybytes() for a, z in zip(cut, cut[1:], strict=False)]
        odd = np.flatnonzero(odd).tolist()
        for i, ids in zip(odd, self._by_pattern([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def _by_pattern(self, texts: list[str]) -> list[bytes]:
        return self._look_up(list(map(self._split, texts)))

    def _split(self, text: str) -> list[str]:
        if not any(t in text for t in self.special):
            return self.pieces(text)
        parts = self.around(text)  # every second one is a special token's string
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.pieces(part))]

    def _look_up(self, split: list[list[str]]) -> list[bytes]:
        found = [list(map(self.cache.get, pieces)) for pieces in split]
        gaps = [[i for i, x in enumerate(parts) if x is None] for parts in found]
        new = list({pieces[i] for pieces, gap in zip(split, gaps, strict=True) for i in gap})
        full = self._learn(new)
        for pieces, parts, gap in zip(split, found, gaps, strict=True):
            for i in gap:
                parts[i] = self.cache[pieces[i]]
        self._forget(new, full)
        return list(map(b"".join, found))

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Of distinct pieces."""
        found = list(map(self.cache.get, pieces))
        gap = [i for i, x in enumerate(found) if x is None]
        new = [pieces[i] for i in gap]
        full = self._learn(new)
        for i, w in zip(gap, new, strict=True):
            found[i] = self.cache[w]
        self._forget(new, full)
        return found

    def _learn(self, new: list[str]) -> bool:
        """Puts new pieces into the cache and says whether they are too many to stay there."""
        full = len(self.cache) + len(new) > CACHE_PIECES
        plain = [w for w in new if self.plain(w)]
        if self.spaced:
            self._encode_by_model(plain)
        else:
            for at in range(0, len(plain), JOINED):
                self._encode_words(plain[at : at + JOINED])
        self._encode([w for w in new if w not in self.cache])
        return full

    def _forget(self, new: list[str], full: bool) -> None:
        for w in new:
            if full or len(w) > CACHE_CHARS:
                del self.cache[w]

    def _encode(self, pieces: list[str]) -> None:
        found = self.tok.encode_batch_fast(pieces, add_special_tokens=False)
        self.cache.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(pieces, found, strict=True))

    def _encode_by_model(self, words: list[str]) -> None:
        ids: list[int] = []
        cut = [0]
        for w in words:
            mapped = w.replace(" ", "\u0120") if w.isascii() else w.encode().decode("latin-1").translate(ALPHABET)
            ids += [t.id for t in self.model.tokenize(mapped)]
            cut.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        self.cache.update((w, raw[a:z]) for w, a, z in zip(words, cut, cut[1:], strict=False))

    def _encode_words(self, words: list[str]) -> None:
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.append(0, np.flatnonzero(self.edge[ids]) + 1)
        if len(cut) != len(words) + 1 or cut[-1] != len(ids):
            return  # left to _encode
        raw, cut = ids.tobytes(), (4 * cut).tolist()
        self.cache.update((w, raw[a:z]) for w, a, z in zip(words, cut, cut[1:], strict=False))


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """The encoder of a file, which a reused Python worker keeps from task to task."""
    return WordEncoder(path)
