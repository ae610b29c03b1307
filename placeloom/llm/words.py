"""Words of many texts at once, as numpy arrays over one buffer."""

from __future__ import annotations

import numpy as np

from placeloom.llm.common import SEED_WORD, SPACES

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
#: Bytes that are hashed together, and the length above which a word is hashed by itself.
_PART, _LONG = 1 << 20, 256
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, from the 0th on."""
    if name not in _POWERS or len(_POWERS[name]) < n:
        steps = np.full(max(n, _PART + 2 * _LONG + 2), base % (1 << 64), np.uint64)
        steps[0] = 1
        _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS[name]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words (runs of other bytes than white space) of texts, end to end.

    data: the words, a space after each; offset: where each begins in it, and its length at last;
    sizes: words of each text.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        joined = b" ".join(t or b"" for t in texts) + b" "
        raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        space = _SPACE[raw]
        before = np.concatenate([[True], space[:-1]])
        begin = np.flatnonzero(before & ~space)
        kept = raw[~(before & space)]  # of white space the first byte
        self.data = np.where(_SPACE[kept], np.uint8(32), kept).tobytes()
        end = np.flatnonzero(space & ~before)
        self.offset = np.append(0, np.cumsum(end - begin + 1))
        text_end = np.cumsum(np.array([len(t or b"") + 1 for t in texts], np.int64))
        self.sizes = np.diff(np.searchsorted(begin, text_end), prepend=0)

    def __len__(self) -> int:
        return len(self.offset) - 1

    def slice(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        return self.data[self.offset[a] : self.offset[b] - 1] if b > a else b""

    def hashes(self) -> np.ndarray:
        """64 bits for each word: a polynomial over its bytes; words longer than _LONG by XXH64."""
        import xxhash

        data, offset = np.frombuffer(self.data, np.uint8), self.offset
        size = np.diff(offset)
        long = np.flatnonzero(size > _LONG)
        out = np.empty(len(self), np.uint64)
        up, down = _powers("up", _BASE, 0), _powers("down", pow(_BASE, -1, 1 << 64), 0)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(offset, offset[a] + _PART, "right")) - 1)
            if offset[b] - offset[a] <= len(up):
                begin = offset[a:b] - offset[a]
                out[a:b] = np.add.reduceat(data[offset[a] : offset[b]] * up[: offset[b] - offset[a]], begin) * down[begin]
            a = b
        out = mix(out ^ np.uint64(SEED_WORD))
        for k in long.tolist():
            out[k] = xxhash.xxh64_intdigest(self.data[offset[k] : offset[k + 1] - 1]) ^ SEED_WORD
        return out

