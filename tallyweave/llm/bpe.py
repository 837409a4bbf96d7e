"""Byte-pair encoding with the vocabulary of a public tokenizer.

The encoder backtracks over longest token matches. An Aho-Corasick automaton
gives the longest token that starts at each byte; a token is accepted if it is
compatible with the one before, that is if the merges of the two texts together
never cross their border. If no shorter token fits either, the last accepted
token is taken back. Each byte position is given up at most once, so the time is
linear in the text, and the result equals that of the merges in rank order.

Texts are cut into chunks at single blanks, and a worker remembers the ids of
chunks it has met; that memory is a cache of bounded size and has no influence
on the result. Null and empty texts have no ids (an empty list). Strings that
look like special tokens are ordinary text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER_DIR = "/opt/tokenizers"
_CACHE_ENTRIES = 1 << 17
# Unicode White_Space, as the tokenizer's \s; str.isspace also has U+001C to U+001F. Fixed values.
_SPACE = "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _char_class(letter: str) -> str:
    """A regular-expression class body of all characters of a general category."""
    out, start = [], None
    for cp in range(0x110001):
        inside = cp < 0x110000 and unicodedata.category(chr(cp))[0] == letter
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


class Vocabulary:
    """Tokens, merges and their tables; built from a tokenizers JSON file's text."""

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        alphabet = _byte_alphabet()
        ids = model["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            if all(c in alphabet for c in token):
                self.bytes_of[i] = bytes(alphabet[c] for c in token)
        self.parts = [(i, i) for i in range(len(self.bytes_of))]
        self.rank = [-1] * len(self.bytes_of)
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            whole = ids[left + right]
            pair = (ids[left], ids[right])
            self.merged[pair] = r
            if self.rank[whole] < 0:
                self.parts[whole], self.rank[whole] = pair, r
        # what merges never build is no token of the encoding, save the single bytes
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b and (self.rank[i] >= 0 or len(b) == 1)}
        self._offsets = np.r_[0, np.cumsum([len(b) for b in self.bytes_of])]
        self._blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """The bytes of ids, copied from one table of all tokens by their offsets."""
        ids = np.asarray(ids, np.int64)
        if not ids.size:
            return b""
        start, length = self._offsets[ids], self._offsets[ids + 1] - self._offsets[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
        return self._blob[at].tobytes()


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        v = self.vocabulary = vocabulary
        self._automaton = ahocorasick.Automaton()
        for b, i in v.id_of.items():
            self._automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self._automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        letter, number = _char_class("L"), _char_class("N")
        # the pre-tokenizer's pattern, with classes written out for the plain re module. Fixed values.
        self._pieces = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
        ).findall
        self._runs = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
        self._edge = re.compile(f"\\A[{_SPACE}]|[{_SPACE}]\\Z").search
        self._piece_ids: dict[str, bytes] = {}
        self._first = _Chunks(self, "")
        self._later = _Chunks(self, " ")

    # -- one piece
    def _compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both texts together is just these two tokens.

        The merges are undone from the latest to the earliest; at each moment the
        two tokens at the border must not form a pair that merges before.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is not None:
            return known
        v = self.vocabulary
        before, fits = len(v.rank) + 1, True
        while True:
            r = v.merged.get((left, right))
            if r is not None and r < before:
                fits = False
                break
            if v.rank[left] > v.rank[right]:
                # merges of equal rank happen from left to right: inside the left token first
                before, left = v.rank[left], v.parts[left][1]
            elif v.rank[right] >= 0:
                before, right = v.rank[right] + 1, v.parts[right][0]
            else:
                break
        if len(self._fits) > 4 * _CACHE_ENTRIES:
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of a token, or -1."""
        s = self._shorter.get(token)
        if s is None:
            b, s = self.vocabulary.bytes_of[token], -1
            for n in range(len(b) - 1, 0, -1):
                s = self.vocabulary.id_of.get(b[:n], -1)
                if s >= 0:
                    break
            self._shorter[token] = s
        return s

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-tokenizer piece."""
        n = len(data)
        longest = [-1] * (n + 1)
        for end, (token, length) in self._automaton.iter(data.decode("latin-1")):
            longest[end + 1 - length] = token  # ends rise, so the longest comes last
        lengths = self.vocabulary.bytes_of
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            while True:
                end = at + len(lengths[token])
                if open_at[end] and (not out or self._compatible(out[-1], token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = self._next_shorter(token)
                if token < 0:
                    # nothing fits here: never come back to this place, take the last token back
                    open_at[at] = 0
                    token = out.pop()
                    at -= len(lengths[token])
        return out

    # -- whole texts
    def _encode_run(self, text: str) -> bytes:
        known, out = self._piece_ids, []
        for piece in self._pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode("utf-8", "replace")), np.int32).tobytes()
                if len(known) > _CACHE_ENTRIES:
                    known.clear()
                if len(piece) < 64:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as packed 32-bit integers.

        The border before a blank between two other characters is always one
        between pieces, so the parts between blanks can be encoded apart. Texts
        with wider or other white space there are cut after each run of it.
        """
        if not text:
            return b""
        words = text.split(" ")
        first = words[0]
        words[0] = "x"
        try:
            rest = list(map(self._later.__getitem__, words))
            rest[0] = self._first[first]
            return b"".join(rest)
        except _Unclean:
            return b"".join(map(self._first.any_run, self._runs(text)))


class _Unclean(Exception):
    pass


class _Chunks(dict):
    """Ids by chunk, for chunks that follow ``lead``; unclean chunks raise."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead
        self.runs: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        e = self.encoder
        if not chunk or e._edge(chunk):
            raise _Unclean
        ids = e._encode_run(self.lead + chunk)
        if len(self) > _CACHE_ENTRIES:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def any_run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            ids = self.encoder._encode_run(run)
            if len(self.runs) > _CACHE_ENTRIES:
                self.runs.clear()
            if len(run) < 64:
                self.runs[run] = ids
        return ids


_encoders: dict[int, Encoder] = {}


def encoder_of(text: str) -> Encoder:
    """The encoder of a vocabulary, built once per process."""
    key = hash(text)
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(text))
    return _encoders[key]


def vocabulary_text(tokenizer_dir: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> str:
    return Path(tokenizer_dir, f"{name}.json").read_text()


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(<id>, ids array<int>) for every row; null and empty texts give an empty list.

    Texts of any length are encoded whole. Rows are independent: null and repeated
    ids stay as they are, other columns are not read, an empty table gives no rows.

    Rows are encoded where they are read: no shuffle. The vocabulary, a file of
    fixed size, is the only thing broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text(tokenizer_dir))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shared.value).encode
        for b in batches:
            packed = [encode(t) for t in b.column(1).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(p) // 4 for p in packed])].astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], [id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(<id>, n_tokens long) for every row; null and empty texts have 0."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text(tokenizer_dir))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shared.value).encode
        for b in batches:
            n = pa.array([len(encode(t)) // 4 for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], [id_column, "n_tokens"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long")
