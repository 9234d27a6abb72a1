"""Words of whole Arrow text columns by byte tables, without a Python object for each word.

A byte is part of a word, parts words, or parts pieces as well. All bytes that part are ASCII, so
words of valid UTF-8 are valid too; only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

WORD, SPACE, STOP = 0, 1, 2


def byte_kinds(spaces: str | bytes, stops: bytes = b""):
    """256 kinds: those of ``spaces`` part words, those of ``stops`` part pieces, others are of words."""
    import numpy as np

    kinds = np.zeros(256, np.uint8)
    kinds[list(spaces)] = SPACE
    kinds[list(stops)] = STOP
    return kinds


def slices(batch, most_bytes: int, column: str = "text") -> Iterator:
    """Runs of a batch's rows with about ``most_bytes`` of text each; one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts, kinds):
    """(words as an Arrow string array, the row of each, the piece of each) of a text column.

    Pieces count up over all rows; each row begins one. Null text has no words.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kind = kinds[data]
    inside = kind == WORD
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = begins[begins > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == STOP)[starts] + row if len(starts) else row
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(lower[data[inside]])])
    return words.cast(pa.string()), row, piece


def sums_by_key(keys, *values):
    """(distinct keys, their number, sums of each of ``values``), all whole numbers."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(keys)))
    return ordered[at], counts, *[np.add.reduceat(v[order], at) if len(keys) else v for v in values]
