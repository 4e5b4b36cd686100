"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the text after
lower-casing ``A-Z`` only.  Every word gets a 64-bit hash; two different words
share one with a chance of about 2**-64.  Nulls count as empty texts.
"""

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 512 << 10  # text bytes that are hashed at once: bounds the scratch arrays to about 40 bytes each

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWERED = np.frombuffer(_LOWER, dtype=np.uint8)
_IS_WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
END = np.uint64(0x2545F4914F6CDD1D)  # stands for the end of a text


def mix(x):
    """Finaliser that spreads every bit of uint64 values over all bits."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER_VALUE = _BYTE_VALUE[_LOWERED]
_POWERS = {}


def powers(base, n):
    """base**0 .. base**(n - 1) modulo 2**64; the longest table so far is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:  # doubles the table: p[k + i] = p[i] * base**k
            more = min(filled, size - filled)
            have[filled : filled + more] = have[:more] * np.uint64(pow(base, filled, 1 << 64))
            filled += more
        _POWERS[base] = have
    return have[:n]


def string_bytes(column):
    """(bytes as uint8, offsets) of a string array without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(column):
    """Yields (first row, bytes, offsets) for runs of whole texts of about CHUNK_BYTES."""
    data, offsets = string_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        part = offsets[first : last + 1]
        yield first, data[part[0] : part[-1]], part - part[0]
        first = last


def lower(data):
    return np.frombuffer(data.tobytes().translate(_LOWER), dtype=np.uint8)


def pieces(data, lead):
    """Yields (start, end, words) of parts of one text of about CHUNK_BYTES, cut beside words.

    A part begins with the last words of the one before, lead at most; words says how many.
    """
    end, n = 0, len(data)
    while end < n or not n:
        start, stop = end, min(n, end + CHUNK_BYTES)
        while stop < n and _IS_WORD[data[stop - 1]] and _IS_WORD[data[stop]]:  # not inside a word
            gap = np.flatnonzero(~_IS_WORD[data[stop : stop + 4096]])
            stop = stop + int(gap[0]) if len(gap) else min(n, stop + 4096)
        first, before = start, 0
        if start and lead:
            low = max(0, start - CHUNK_BYTES)
            opens, _, _ = word_bounds(data[low:start], np.array([0, start - low]))
            opens = opens[1:] if low and len(opens) else opens  # the first may be a part of a word
            before = min(lead, len(opens))
            first = low + int(opens[-before]) if before else start
        yield first, stop, before
        end = stop
        if not n:
            return


def word_bounds(data, offsets):
    """(starts, ends, row) of the words; words never cross the border of two texts."""
    is_word = _IS_WORD[data]
    n = len(data)
    opens = is_word.copy()
    opens[1:] &= ~is_word[:-1]
    closes = is_word.copy()
    closes[:-1] &= ~is_word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    opens[inner] = is_word[inner]
    closes[inner - 1] = is_word[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data, offsets):
    """(hash of each word, row of each word); A-Z hash as lower-cased.

    Bytes are taken CHUNK_BYTES at a time, so scratch doesn't grow with a text; a
    word that is cut there is put together again: its hash is a polynomial.
    """
    raw, size, row = [], [], []
    for a in range(0, len(data), CHUNK_BYTES):
        part = data[a : a + CHUNK_BYTES]
        low, high = np.searchsorted(offsets, [a, a + len(part)], side="right")
        starts, ends, _ = word_bounds(part, np.concatenate([[0], offsets[low:high] - a, [len(part)]]))
        if not len(starts):
            continue
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_LOWER_VALUE[part] * powers(_BASE, len(part)), out=total[1:])
        value = (total[ends] - total[starts]) * powers(_INVERSE, len(part))[starts]
        length, of = (ends - starts).astype(np.uint64), (np.searchsorted(offsets, a + starts, side="right") - 1).astype(np.int32)
        if starts[0] == 0 and row and of[0] == row[-1][-1] and _IS_WORD[data[a - 1]]:
            raw[-1][-1:] += value[:1] * np.uint64(pow(_BASE, int(size[-1][-1]), 1 << 64))
            size[-1][-1:] += length[:1]
            value, length, of = value[1:], length[1:], of[1:]
        if len(of):
            raw.append(value)
            size.append(length)
            row.append(of)
    if not row:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    if len(row) > 1:
        raw, size, row = ([np.concatenate(x)] for x in (raw, size, row))
    size[0] *= np.uint64(0xD6E8FEB86659FD93)
    size[0] ^= raw[0]
    return mix(size[0]), row[0]


def shingles(hashes, width):
    """Hashes of all runs of width words; the whole sequence as one if it is shorter."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, CHUNK_BYTES):
        part = np.full(min(CHUNK_BYTES, n - at), np.uint64(width))
        for k in range(width):
            part *= np.uint64(_BASE)
            part += hashes[at + k : at + k + len(part)]
            part = mix(part)
        out[at : at + len(part)] = part
    return out
