"""Document fingerprints: a digest of the quartiles of byte-triplet counts.

Every run of three bytes of the UTF-8 text is hashed to one of 256 buckets. A bucket is coded 0 to 3
by the quartile of the 256 counts that its count is above; the digest is one byte for the length
(its logarithm) and two bits per bucket, in hexadecimal. The difference of two digests is the sum
of the code differences, a step over three quartiles counting double, plus a bounded part for the
lengths; likeness is 1 less the share of the largest difference there can be.

Texts are hashed whole: whatever their size, in pieces that overlap by two bytes.

Defined cases: a null text is an empty one; texts of less than three bytes have no triplets and
differ by their length code alone; equal texts have equal digests.
"""

from __future__ import annotations

import numpy as np

BUCKETS = 256
#: Bytes hashed at once.
PIECE = 1 << 20
#: Length codes per doubling of the length, and the largest difference of codes that counts.
LENGTH_STEPS, LENGTH_MOST = 4, 24
LENGTH_WEIGHT = 4
_STEP = np.array([0, 1, 2, 6], np.int32)
_MOST = BUCKETS * 6 + LENGTH_MOST * LENGTH_WEIGHT


def _bucket(a: np.ndarray) -> np.ndarray:
    """Bucket of the triplet at each place but the last two."""
    b = a.astype(np.uint32)
    mixed = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)
    return mixed >> np.uint32(24)


def triplet_counts(texts: list[bytes]) -> np.ndarray:
    """One row of bucket counts per text."""
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    run: list[int] = []
    size = 0

    def settle() -> None:
        joined = np.frombuffer(b"".join(texts[i] for i in run), np.uint8)
        if len(joined) < 3:
            return
        ends = np.cumsum([len(texts[i]) for i in run])
        row = np.repeat(np.arange(len(run)), [len(texts[i]) for i in run])[:-2]
        inside = np.arange(len(joined) - 2) + 2 < ends[row]
        flat = row * BUCKETS + _bucket(joined)
        found = np.bincount(flat[inside], minlength=len(run) * BUCKETS)
        counts[run] = found.reshape(len(run), BUCKETS)

    for i, t in enumerate(texts):
        if len(t) > PIECE:
            for at in range(0, len(t) - 2, PIECE):
                piece = np.frombuffer(t[at : at + PIECE + 2], np.uint8)
                counts[i] += np.bincount(_bucket(piece), minlength=BUCKETS)
            continue
        if size + len(t) > PIECE:
            settle()
            run, size = [], 0
        run.append(i)
        size += len(t)
    if run:
        settle()
    return counts


def codes(texts: list[bytes]) -> np.ndarray:
    """Per text: the length code, then one code per bucket."""
    counts = triplet_counts(texts)
    q = np.sort(counts, 1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    out = np.zeros((len(texts), BUCKETS + 1), np.uint8)
    for k in range(3):
        out[:, 1:] += counts > q[:, k : k + 1]
    sizes = np.array([len(t) for t in texts], float)
    out[:, 0] = np.minimum(255, np.round(LENGTH_STEPS * np.log2(1 + sizes)))
    return out


def written(code: np.ndarray) -> list[str]:
    """Digests as lowercase hexadecimal: two digits of length, two bits per bucket."""
    pairs = code[:, 1:].reshape(len(code), BUCKETS // 4, 4)
    packed = pairs[:, :, 0] << 6 | pairs[:, :, 1] << 4 | pairs[:, :, 2] << 2 | pairs[:, :, 3]
    return [bytes(x).hex() for x in np.concatenate([code[:, :1], packed], 1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of codes, row by row: 1 for equal ones, never below 0."""
    steps = _STEP[np.abs(a[:, 1:].astype(np.int16) - b[:, 1:].astype(np.int16))].sum(1)
    length = np.minimum(
        np.abs(a[:, 0].astype(np.int16) - b[:, 0].astype(np.int16)), LENGTH_MOST
    )
    return 1.0 - (steps + LENGTH_WEIGHT * length) / _MOST
