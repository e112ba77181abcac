"""Encoding with a public byte-level BPE vocabulary, by dynamic programming over prefixes.

BPE has one property that makes it a left-to-right problem: the encoding of every prefix ends in
exactly one token, and a token t may end a prefix if and only if the pair (last token of the prefix
without t, t) is one that the merges themselves would leave apart. So for each prefix the suffix
matches are tried from the longest to the shortest, the first compatible one is stored, and the ids
are read off by following the stored tokens back from the end.

Null and empty texts both have the ids []: a text without characters has no tokens. White space,
control characters and lone surrogates' replacements are encoded like any other bytes.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

DEFAULT_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.json"

# The pattern which cuts text into pieces before merging, as published with the
# vocabulary, and the characters it counts as white space.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A chunk is a run without white space, with one blank before it, or a run of white space. No
#: piece crosses from one chunk to the next, so chunks can be remembered whole.
CHUNKS = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Bytes that each remembering table of a worker may hold, roughly, before it starts afresh, and the
#: longest text it remembers.
KEEP, LONGEST = 96 << 20, 256


class _Memo(dict):
    """A dict that fills itself by a function and is emptied when it holds KEEP bytes; long texts aren't kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) > LONGEST:
            return value
        # A dict's slot, the two objects' heads, and a text's characters or a tuple's numbers.
        self.held += 240 + 4 * len(key) + (8 * len(value) if isinstance(value, tuple) else 0)
        if self.held > KEEP:
            self.clear()
            self.held = 0
        self[key] = value
        return value


def _printable_bytes() -> dict[str, int]:
    """The one-character names that byte-level vocabularies in JSON give to the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    names.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return names


def _parts(ids: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens that each token of a rank file is merged from: what the merges below it leave of it."""
    out = {}
    for word, rank in ids.items():
        if len(word) < 2:
            continue
        have = [word[i : i + 1] for i in range(len(word))]
        while len(have) > 2:
            low, at = min(
                (r, i) for i in range(len(have) - 1) if (r := ids.get(have[i] + have[i + 1])) is not None and r < rank
            )
            have[at : at + 2] = [have[at] + have[at + 1]]
        out[rank] = ids[have[0]], ids[have[1]]
    return out


class PrefixEncoder:
    """The vocabulary of one file with its suffix matcher and the test of neighbouring tokens."""

    def __init__(self, content: bytes, kind: str):
        import re

        import ahocorasick
        import regex

        if kind == ".json":
            file = json.loads(content)
            model = file["model"]
            plain = model.get("type", "BPE") == "BPE" and not model.get("end_of_word_suffix") and not file.get("normalizer")
            if not plain or (file.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
                raise ValueError("not a byte-level pair encoding")
            names = _printable_bytes()
            ids = {bytes(names[c] for c in w): i for w, i in model["vocab"].items() if all(c in names for c in w)}
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            back = model["vocab"]
            self.parts = {back[a + b]: (back[a], back[b]) for a, b in pairs}
        elif kind != ".tiktoken":
            raise ValueError(f"a vocabulary in .json or .tiktoken is needed, not {kind}")
        else:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
            self.parts = _parts(ids)
        self.merged = {p: t for t, p in self.parts.items()}
        self.length = {i: len(w) for w, i in ids.items()}
        self.matcher = ahocorasick.Automaton()
        for word, i in ids.items():
            if len(word) == 1 or i in self.parts:
                self.matcher.add_word(word.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.apart = _Memo(lambda pair: self._apart(*pair))
        self.piece_ids = _Memo(self._encode_piece)
        self.chunk_ids = _Memo(self._encode_chunk)
        self.pieces = regex.compile(PIECES).findall
        self.chunks = re.compile(CHUNKS).findall

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right apart when they meet.

        Undo the later of the two merges at the seam again and again; if any pair of tokens that
        met there would have been merged before it disappeared, the two don't stay apart.
        """
        bound = float("inf")
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            opened_left, opened_right = self.parts.get(left), self.parts.get(right)
            if opened_left is None and opened_right is None:
                return True
            if opened_right is None or (opened_left is not None and left > right):
                bound, left = left, opened_left[1]
            else:
                bound, right = right + 1, opened_right[0]

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace").decode("latin-1")
        last: list[int] = [-1] * len(data)
        length, apart = self.length, self.apart
        for end, token in self.matcher.iter(data):  # of each end the longest match first
            if last[end] < 0:
                before = end - length[token]
                if before < 0 or apart[last[before], token]:
                    last[end] = token
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= length[last[at]]
        return tuple(out[::-1])

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece_ids.__getitem__, self.pieces(chunk))))

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        return list(chain.from_iterable(map(self.chunk_ids.__getitem__, self.chunks(text))))


_LOADED: dict[str, PrefixEncoder] = {}


def _encoder(name: str, content: bytes) -> PrefixEncoder:
    if name not in _LOADED:
        _LOADED[name] = PrefixEncoder(content, os.path.splitext(name)[1])
    return _LOADED[name]


def load(name: str = BYTE_BPE_50K, folder: str = DEFAULT_DIR) -> PrefixEncoder:
    """The encoder of a vocabulary file, for use outside Spark."""
    with open(os.path.join(folder, name), "rb") as f:
        return _encoder(os.path.join(folder, name), f.read())


def _shared(spark: SparkSession, name: str, folder: str):
    """The file's content as a broadcast: a vocabulary is a few MB at every size of the corpus."""
    ship(spark)
    with open(os.path.join(folder, name), "rb") as f:
        return os.path.join(folder, name), spark.sparkContext.broadcast(f.read())


def token_ids(text: Column | str, name: str = BYTE_BPE_50K, folder: str = DEFAULT_DIR) -> Column:
    """A column ARRAY<INT> with the ids of each text, without special tokens; [] for null and empty texts."""
    spark = SparkSession.getActiveSession()
    path, content = _shared(spark, name, folder)

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoder(path, content.value)
        get, chunks = enc.chunk_ids.__getitem__, enc.chunks
        for texts in batches:
            flat, ends = [], [0]
            for t in texts.to_pylist():
                if t:
                    flat.extend(chain.from_iterable(map(get, chunks(t))))
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return F.arrow_udf(ids, "array<int>")(text)


def token_count(text: Column | str, name: str = BYTE_BPE_50K, folder: str = DEFAULT_DIR) -> Column:
    """A column BIGINT with the number of ids of each text; 0 for null and empty texts."""
    spark = SparkSession.getActiveSession()
    path, content = _shared(spark, name, folder)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoder(path, content.value)
        get, chunks = enc.chunk_ids.__getitem__, enc.chunks
        for texts in batches:
            yield pa.array([sum(map(len, map(get, chunks(t)))) if t else 0 for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(count, "bigint")(text)
