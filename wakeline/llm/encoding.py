"""Exact token ids and counts of whole texts, each distinct unit of text encoded once.

A text is split at safe boundaries: after a letter and before an ASCII character that is no
letter, and before white space that follows a visible ASCII character.  The pre-tokenizers
of the vocabularies used here always break there, so the tokens of a text are those of its
units in order.  Units are numbered by Arrow's dictionary encoding, and only units not seen
before are encoded, in batches of about equal bytes.  A text with ``<|``, which may start a
special token, is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

#: Rows of one Arrow batch are worked on in runs of about so many bytes.
RUN_BYTES = 4 << 20
#: Units are encoded in batches of about so many bytes.
ENCODE_BYTES = 64 << 10
#: Units remembered in a Python worker; beyond it the memory starts afresh.
REMEMBERED = 1_000_000

_ASCII_LETTER, _SPACE, _VISIBLE = (np.zeros(256, bool) for _ in range(3))
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE[[*range(9, 14), 32]] = True
_VISIBLE[0x21:0x7F] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; nulls are empty."""
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0]: offsets[-1]], offsets - offsets[0]


def runs(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about equal bytes; a longer text is a run by itself."""
    _, offsets = flat(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + run_bytes, "right")) - 1
        last = min(len(texts), max(first + 1, last))
        yield first, last
        first = last


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at safe boundaries and at the start of every non-empty text."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    letter = _ASCII_LETTER[data]
    high = data >= 0x80
    # the second byte of a Latin letter from U+00C0 on, without the two signs among them
    latin = np.zeros(len(data), bool)
    latin[1:] = high[1:] & (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    plain = ~letter & ~high
    starts = np.zeros(len(data), bool)
    starts[1:] = ((letter | latin)[:-1] & plain[1:]) | (_VISIBLE[data[:-1]] & _SPACE[data[1:]])
    begins = offsets[:-1]
    starts[begins[begins < offsets[1:]]] = True
    return np.flatnonzero(starts)


def special_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows whose text has ``<|``."""
    at = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    return np.unique(row[at + 1 < offsets[row + 1]])


class Encoder:
    """Encodes distinct units of text and remembers what they gave.

    ``keep`` turns the ids of one unit into what is remembered: their number or their bytes.
    """

    def __init__(self, vocabulary: str, keep: Callable, lower: bool):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.keep, self.lower, self.seen = keep, lower, {}

    def encode(self, texts: list[str]) -> list:
        out, batch, size = [], [], 0
        for text in texts:
            batch.append(text)
            size += len(text)
            if size >= ENCODE_BYTES:
                out += self._batch(batch)
                batch, size = [], 0
        return out + self._batch(batch)

    def _batch(self, texts: list[str]) -> list:
        return [self.keep(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def units(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray, dict]:
        """Results of the distinct units, each unit's number, the first unit of each row
        (and the end), and the whole results of special rows by row number."""
        data, offsets = flat(texts)
        starts = unit_starts(data, offsets)
        rows = np.searchsorted(starts, offsets)
        special = special_rows(data, offsets)
        whole = dict(zip(special.tolist(), self.encode([texts[int(r)].as_py() for r in special]), strict=True))
        if len(starts) == 0:
            return [], np.zeros(0, np.int64), rows, whole
        held = _LOWER[data] if self.lower else np.ascontiguousarray(data)
        ends = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(held)]).dictionary_encode()
        keys = coded.dictionary.to_pylist()
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        new = [k for k in keys if k not in seen]
        seen.update(zip(new, self.encode([k.decode() for k in new]), strict=True))
        return [seen[k] for k in keys], coded.indices.to_numpy(zero_copy_only=False), rows, whole


_ENCODERS: dict = {}


def count_of(encoding) -> int:
    return len(encoding.ids)


def bytes_of(encoding) -> bytes:
    return np.asarray(encoding.ids, np.uint32).tobytes()


def encoder(vocabulary: str, keep: Callable, lower: bool = False) -> Encoder:
    """One encoder a worker process; ``lower`` for vocabularies that lower-case anyway."""
    key = vocabulary, keep.__name__, lower
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, keep, lower)
    return _ENCODERS[key]


def counts(enc: Encoder, texts: pa.Array) -> np.ndarray:
    """Tokens of each text."""
    found, codes, rows, whole = enc.units(texts)
    total = np.concatenate([[0], np.cumsum(np.asarray(found, np.int64)[codes])]) if len(codes) else np.zeros(1, np.int64)
    out = total[rows[1:]] - total[rows[:-1]]
    for row, n in whole.items():
        out[row] = n
    return out


def ids(enc: Encoder, texts: pa.Array, end: int) -> list[np.ndarray]:
    """The ids of each text, then ``end``."""
    found, codes, rows, whole = enc.units(texts)
    sizes = np.fromiter((len(f) // 4 for f in found), np.int64, len(found))
    pool = np.frombuffer(b"".join(found), np.uint32)
    begin = np.cumsum(sizes) - sizes
    each = sizes[codes]
    stop = np.cumsum(each)
    at = np.repeat(begin[codes] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)
    stream, bounds = pool[at], np.concatenate([[0], stop])[rows]
    tail = np.asarray([end], np.uint32)
    return [np.concatenate([np.frombuffer(whole[i], np.uint32) if i in whole else stream[bounds[i]: bounds[i + 1]], tail])
            for i in range(len(texts))]
