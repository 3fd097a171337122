"""Words of whole texts as 64-bit hashes, computed on the UTF-8 bytes of many texts at once.

Word classes are sets of bytes.  That is exact for classes that hold all or none of the
non-ASCII characters, since every byte of such a character is above 0x7F.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_KEPT_POWERS = (1 << 20) + (1 << 17)  # blocks of texts are about 1 MB; longer ones compute their own

_bytes = np.arange(256)
FOLD = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: [^\x20\x09-\x0D]
NOT_BLANK = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], to be used on lower-cased bytes
WORDY = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(32))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, _KEPT_POWERS), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= _KEPT_POWERS:
            _POWERS[base] = known
    return known[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, from prefix sums of a polynomial modulo 2 ** 64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _powers(_P, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_P_INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


@dataclass
class Words:
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after it
    first: np.ndarray  # text i has the words first[i] .. first[i + 1] - 1


def split(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Words:
    """Maximal runs of bytes in ``word``; no run goes on from one text to the next."""
    inside = word[data]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[begins[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))
