"""Splitting text into pre-tokens, and cached encoding of single pre-tokens, inside tasks."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: White space as Unicode has it; Python's own classes also hold U+001C..U+001F.
_SPACE = r"\t-\r \x85\xa0"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: The byte-level pattern with explicit classes for texts up to U+024F, which the standard engine matches faster.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words kept in a worker's cache, and the longest that is.
CACHE_WORDS, CACHE_CHARS = 600_000, 48


def pre_tokens(text: str) -> list[str]:
    """The consecutive matches of the byte-level pattern; their concatenation is ``text``."""
    return (_ANY if _BEYOND_LATIN.search(text) else _LATIN).findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the
    other bytes follow in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordIds(dict):
    """Pre-token to the bytes of its ids (little-endian, ``dtype``); encodes what is missing and keeps short words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = _ANY.pattern):
        super().__init__()
        self.dtype = np.dtype("<u2" if max(ranks.values()) < 65_536 else "<u4")
        # a pattern that matches everything: words come cut already
        self._encode = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self._encode(word), self.dtype).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class ByteLevelEncoder:
    """Ids of whole texts as the ``tokenizers`` library gives them for a byte-level BPE file.

    Works on pre-tokens with a cache when the file is of the plain byte-level kind (no normaliser, ids in merge order,
    added tokens without strip or word rules); any other file goes to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = spec.get("added_tokens") or []
        order = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
        vocab = model.get("vocab", {})
        specials = {t["content"]: t["id"] for t in added}
        plain = (
            model.get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(order))
        )
        self.plain, self.specials = plain, specials
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        if plain:
            alphabet = byte_alphabet()
            self.words = WordIds({bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in specials})
            self.words.dtype = self.dtype
            self._special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def ids(self, text: str) -> bytes:
        """Little-endian ids of ``dtype``, without added begin or end tokens."""
        if not self.plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if self._special is None or not any(s in text for s in self.specials):
            return b"".join(map(self.words.__getitem__, pre_tokens(text)))
        parts = self._special.split(text)
        return b"".join(np.array([self.specials[p]], self.dtype).tobytes() if k % 2 else b"".join(map(self.words.__getitem__, pre_tokens(p))) for k, p in enumerate(parts))


@lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """One per worker process; tasks share its cache."""
    return ByteLevelEncoder(path)
