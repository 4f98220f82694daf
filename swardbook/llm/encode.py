"""Whole-text byte-level BPE with a memo of pieces.

A text is cut before every space that precedes a non-space. Byte-level BPE with
the usual split pattern never merges across such a cut, so the ids of a text are
the ids of its pieces in a row. A batch of texts becomes a dictionary of
distinct pieces and their codes; only the dictionary is looked up in the
worker's bounded memo, and pieces that are new go to the tokenizers library many
at a time, as one text whose ids are cut at the ids that begin with a space.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker remembers for good, and of later ones, which make room for each other.
MEMO, YOUNG = 700_000, 200_000
#: Letters of the longest piece that is remembered: longer ones, whole texts without spaces among them, come again too seldom.
LONGEST = 64
#: New pieces in one text for the library, and bytes of text in one batch of ids.
TOGETHER, BYTES = 10_000, 16 << 20
#: Spaces that are no cut: those before white space and at the end.
_ODD = r" (?:\z|[\x09-\x0d\x1c-\x20\x{85}]|\pZ)"
_CUT = re.compile(r"(?= [^\s])")
_PROBE = "Probe it's 12 naïve, (words)\n\n  and…  spaces\t é 　x "


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def small_parts(texts: pa.Array, rows: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of at most rows texts and BYTES bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and (i - first == rows or held + size > BYTES):
            yield first, i
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


class Encoder:
    """Encodes texts to ids; a memo entry is the little-endian bytes of a piece's ids.

    The memo's keys are pieces without their leading space; a text's first
    piece, which may have none, gets one instead.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(chr(256 + 32))]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.cuts = True
        try:
            self.cuts = self.encode(pa.array([_PROBE]), 0)[0].tolist()[:-1] == self._ids(_PROBE)
        except Exception:  # a vocabulary of another kind
            self.cuts = False
        self.memo.clear()
        self.young.clear()

    def _ids(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        plain = [k for k in keys if k and " " not in k and not any(s in k for s in self.special)]
        for i in range(0, len(plain), TOGETHER):
            some = plain[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, dtype=np.int32)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(some) and at[0] == 0:
                found.update(zip(some, (ids[a:b].tobytes() for a, b in zip(at, [*at[1:], len(ids)]))))
        for k in keys:
            if k not in found:
                found[k] = array("i", self._ids(k[1:] if k[:1] == " " else " " + k)).tobytes() if k != " " else b""
        for k, ids in found.items():
            if len(k) > LONGEST:
                continue
            if len(self.memo) < MEMO:
                self.memo[k] = ids
                continue
            if len(self.young) >= YOUNG:
                self.young.clear()
            self.young[k] = ids
        return found

    def _look_up(self, keys: list[str]) -> list[bytes]:
        parts = list(map(self.memo.get, keys))
        new = [i for i, p in enumerate(parts) if p is None]
        for i in new:
            parts[i] = self.young.get(keys[i])
        new = [i for i in new if parts[i] is None]
        if new:
            found = self._learn(list(dict.fromkeys(keys[i] for i in new)))
            for i in new:
                parts[i] = found[keys[i]]
        return parts

    def _pieces(self, texts: pa.Array) -> pa.Array:
        """Each text's pieces without the space before them."""
        lists = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) | (not self.cuts)
        if not odd.any():
            return lists
        slow = []
        for t in texts.filter(pa.array(odd)).to_pylist():
            keys = _CUT.split(t) if self.cuts else [t]
            slow.append([keys[0], *(k[1:] for k in keys[1:])])
        place = np.where(odd, len(odd) + np.cumsum(odd) - 1, np.arange(len(odd)))
        return pa.concat_arrays([lists, pa.array(slow, type=lists.type)]).take(pa.array(place))

    def _codes(self, texts: pa.Array, *more: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(ids of each distinct piece and then more, number of every piece's ids among them, where each text's pieces start)."""
        lists = self._pieces(pc.fill_null(texts, ""))
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        values = lists.flatten()
        coded = values.dictionary_encode()
        first = values.take(pa.array(starts[:-1])).to_numpy(zero_copy_only=False).tolist()
        codes = coded.indices.to_numpy().astype(np.int64)
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = self._look_up(known) + self._look_up([" " + k for k in first]) + list(more)
        codes[starts[:-1]] = len(known) + np.arange(len(first))
        return parts, codes, starts

    def lengths(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0, dtype=np.int64)
        parts, codes, starts = self._codes(texts)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        return np.add.reduceat(sizes[codes], starts[:-1])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, lengths), each text with the end id."""
        if not len(texts):
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        parts, codes, starts = self._codes(texts, array("i", [end]).tobytes())
        codes = np.insert(codes, starts[1:], len(parts) - 1)
        starts = starts + np.arange(len(starts))
        known = np.frombuffer(b"".join(parts), dtype=np.int32)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        froms = np.cumsum(sizes) - sizes
        each = sizes[codes]
        at = np.repeat(froms[codes] - (np.cumsum(each) - each), each)
        at += np.arange(len(at))
        return known[at], np.add.reduceat(each, starts[:-1])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
