"""Encoders over public tokenizer files: one process-wide engine per file, equal to the tokenizers library.

``byte_bpe`` runs a byte-level BPE file (no normaliser, its own regex split) on tiktoken's
engine with ranks taken from the same JSON; ``word_bpe`` does so for a file with ends of words.
A text that holds the string of an added token goes to the library whole, which gives that
token's id.  Tests hold both against the ids of the tokenizers library at its defaults.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer


def library(path: str) -> Tokenizer:
    """The tokenizer by the tokenizers library at its defaults: added tokens' strings in a text give their own ids."""
    return Tokenizer.from_file(path)


def _byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level BPE files: printable Latin-1 stands for itself, the rest for 256 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: the split of byte-level BPE with use_regex, as the file format defines it.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: tiktoken's split steps back over a run of white space and ends the process on very long ones; the library takes any.
LONG_SPACE = 10_000
_SPACE_RUN = re.compile(rf"\s{{{LONG_SPACE}}}")


class ByteBpe:
    """A byte-level BPE file; the library is loaded only once a text needs it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, self.path, self.added = spec["pre_tokenizer"], path, [t["content"] for t in spec["added_tokens"]]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        to_byte, special = _byte_alphabet(), set(self.added)
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.engine = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tok(self) -> Tokenizer:
        return library(self.path)

    def encode_ordinary(self, text: str) -> list[int]:
        """The ids without those that a template adds."""
        if any(t in text for t in self.added) or len(text) > LONG_SPACE and _SPACE_RUN.search(text):
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.engine.encode_ordinary(text)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


class TwoGenerations(dict):
    """A dict of at most 2 x ``limit`` entries: what was not asked for in a generation is forgotten."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def turn(self) -> None:
        """Begin a new generation if this one is full; callers do so only between texts."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


#: Characters on which the short way of ``WordBpe`` is exact: no normalisation applies, lower case is one to one, and the
#: classes of letters, digits and white space are plain ranges.
_SIMPLE = re.compile(r"[\t\n\x0b\x0c\r -~À-ÿ“”‘’–—…¿¡]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")


class WordBpe:
    """A BPE file with ends of words (lower case, white space dropped); ids as little-endian bytes.

    A text of simple characters is split by a plain regular expression, each word gets a mark in
    place of its end, and tiktoken's engine merges with ranks taken from the file; any other text,
    and one with the string of an added token, goes to the tokenizers library whole.
    """

    def __init__(self, path: str):
        self.tok = library(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], _byte_alphabet()
        end = model["end_of_word_suffix"]
        own = lambda t: bytes(to_byte[c] for c in t.removesuffix(end)) + b"\0" * t.endswith(end)
        if any(t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens are looked for in normalised text")
        self.added = [t["content"] for t in spec["added_tokens"]]
        special = set(self.added)
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        by_merge = [vocab[t] for t in dict.fromkeys(merged)]
        joined = [vocab[c + end] for c in to_byte]  # the end joins its character before anything else
        if by_merge != sorted(by_merge) or max(joined) > by_merge[0]:
            raise ValueError(f"{path}: ids don't follow the merges")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        ranks = {own(t): i for t, i in vocab.items()}
        self.engine = tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not _SIMPLE.fullmatch(text) or "×" in text or "÷" in text or any(t in text for t in self.added):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        marked = _marked(text)
        return array(self.code, self.engine.encode_ordinary(marked)).tobytes() if marked else b""


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each Latin-1 byte: its lower case, and 0 for white space, 1 for letters, 2 for digits, 3 for the rest."""
    low = np.frombuffer(bytes(range(256)).decode("latin-1").lower().encode("latin-1", "replace"), dtype=np.uint8)
    kind = np.full(256, 3, dtype=np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = 1
    kind[48:58] = 2
    return low, kind


_LOW, _KIND = _kinds()


def _marked(text: str) -> str:
    """A text of simple characters in lower case, each of its words followed by a zero and white space left out."""
    if "'" not in text and text:
        try:
            raw = np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
        except UnicodeEncodeError:
            pass
        else:  # without apostrophes words are runs of one kind, digits single
            kind = _KIND[raw]
            ends = np.ones(len(raw), dtype=bool)
            np.not_equal(kind[1:], kind[:-1], out=ends[:-1])
            ends |= kind == 2
            keep = kind != 0
            ends &= keep
            out = np.zeros((len(raw), 2), dtype=np.uint8)
            out[:, 0] = _LOW[raw]
            return out[np.stack([keep, ends], axis=1)].tobytes().decode("latin-1")
    words = _SPLIT.findall(text.lower())
    return "\0".join(words) + "\0" if words else ""


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
