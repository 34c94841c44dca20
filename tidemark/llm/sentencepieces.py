"""SentencePiece BPE encoding by a prefix table, and decoding.

For merge-type vocabularies the last token of every prefix's encoding is unique.  The table holds
that token for each prefix: an Aho-Corasick automaton gives the tokens that end at a position, and
the one that is compatible with the last token of the prefix before it is taken; two tokens are
compatible if encoding their concatenation by merges gives the two back.  The ids are then
recovered backwards from the end.  The time is linear in the text.

Texts are cut before the table is built where no piece of the vocabulary holds the two adjoining
characters (a merge across such a place cannot exist), so words are encoded once per worker and
remembered in a bounded cache.  Characters outside the vocabulary become their UTF-8 bytes' ids.

Defined cases: null or empty text gives the begin and end ids alone and decodes to the empty
string; very long texts take linear time and memory; repeated rows give equal rows; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import SentencePieceProcessor

from tidemark.llm.common import documents, texts
from tidemark.llm.tokenizers_fast import TwoGenerations

SPACE = "▁"


class PrefixTable:
    """Merge-type encoder over pieces with scores: {piece: (id, score)}."""

    def __init__(self, pieces: dict[str, tuple[int, float]], limit: int = 1 << 20):
        self.pieces = pieces
        self.piece = {i: p for p, (i, _) in pieces.items()}
        self.fit = TwoGenerations(limit)
        self.automaton = ahocorasick.Automaton()
        for p, (i, _) in pieces.items():
            if self._merge(p) == [p]:  # a piece that its own merges don't reach never appears
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def _merge(self, text: str) -> list[str]:
        """Merges by score, leftmost first: for short strings, to test pairs."""
        parts, pieces = list(text), self.pieces
        while len(parts) > 1:
            best, at = None, -1
            for k, (a, b) in enumerate(pairwise(parts)):
                if (found := pieces.get(a + b)) and (best is None or found[1] > best):
                    best, at = found[1], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fit.get(key)
        if known is None:
            self.fit.turn()
            p, q = self.piece[a], self.piece[b]
            known = self.fit[key] = self._merge(p + q) == [p, q]
        return known

    def ids(self, text: str) -> list[int]:
        """The ids of a text whose characters are all pieces."""
        n = len(text)
        last, before = [0] * n, [-2] * n  # of the prefix that ends at i; -2: none yet
        fit, compatible = self.fit.get, self.compatible
        for end, (i, length) in self.automaton.iter(text):
            if before[end] != -2:
                continue
            start = end - length
            if start >= 0:
                if before[start] == -2:
                    continue
                ok = fit(last[start] << 32 | i)
                if ok is None:
                    ok = compatible(last[start], i)
                if not ok:
                    continue
            last[end], before[end] = i, start
        out, at = [], n - 1
        while at >= 0:
            if before[at] == -2:
                raise ValueError("no encoding: the vocabulary isn't of merge type")
            out.append(last[at])
            at = before[at]
        return out[::-1]


class Codec:
    def __init__(self, path: str, limit: int = 200_000):
        model = SentencePieceProcessor(model_file=path)
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.byte, pieces, self.surface, self.spaced = {}, {}, [], set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(" ⁇ ".encode() if model.is_unknown(i) else b"")
            else:
                pieces[piece] = (i, model.get_score(i))
                self.surface.append(piece.replace(SPACE, " ").encode())
                if piece.startswith(SPACE):
                    self.spaced.add(i)
        if len(self.byte) != 256 or model.normalize(" a  ﬁ ") != (SPACE + " a  ﬁ ").replace(" ", SPACE):
            raise ValueError(f"{path}: only models with byte fallback and the identity normaliser are handled")
        self.chars = {p for p in pieces if len(p) == 1}
        self.joined = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in self.joined):
            raise ValueError(f"{path}: a piece goes on after a space")
        self.table = PrefixTable(pieces)
        self.words, self.units = TwoGenerations(limit), TwoGenerations(limit)

    def _unit(self, unit: str) -> bytes:
        found = self.units.get(unit) or self.units.old.get(unit)
        if found is None:
            if unit in self.chars or len(unit) > 1:
                ids = self.table.ids(unit)
            else:
                ids = [self.byte[b] for b in unit.encode("utf-8")]
            found = np.array(ids, dtype="<u4").tobytes()
        if len(unit) <= 64:
            self.units.turn()
            self.units[unit] = found
        return found

    def _word(self, word: str) -> bytes:
        """A run of spaces and what follows it, cut where no piece joins the two characters."""
        joined, cuts = self.joined, [0]
        cuts += [k + 1 for k in range(len(word) - 1) if word[k : k + 2] not in joined]
        return b"".join([self._unit(word[a:b]) for a, b in pairwise([*cuts, len(word)])])

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids without begin and end."""
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        if SPACE + SPACE in text or text[0] == SPACE:
            keys = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text)
            keys = [k if k.startswith(SPACE + SPACE) else k[1:] for k in keys]
        else:
            keys = text.split(SPACE)
        words = self.words
        try:
            return b"".join([words[k] for k in keys])
        except KeyError:
            words.turn()
        out = []
        for k in keys:
            found = words.get(k)
            if found is None:
                found = words.old.get(k) or self._word(k if k.startswith(SPACE) else SPACE + k)
                if len(k) <= 64:
                    words[k] = found
            out.append(found)
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts in front is taken off again (a byte's space isn't one)."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        if next((i for i in ids if surface[i]), 0) in self.spaced:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    """Every byte that doesn't belong to a valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        bos, eos = (np.array([i], dtype="<u4").tobytes() for i in (c.bos, c.eos))
        for batch in batches:
            ns, shas, texts_ = [], [], []
            for x in batch.column("text"):
                raw = bos + c.encode(x.as_py()) + eos
                ns.append(len(raw) // 4)
                shas.append(hashlib.sha256(raw).hexdigest())
                back = c.decode(np.frombuffer(raw, "<u4").tolist())
                texts_.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(shas), pa.array(texts_)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [[c.bos, *np.frombuffer(c.encode(x.as_py()), "<u4").tolist(), c.eos] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with begin and end ids."""
    return texts(docs, id_col, text_col).mapInArrow(_ids(model or public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to the empty string."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            back = [c.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return texts(documents(spark, sf_dir)).mapInArrow(_rows(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
