"""The draws of functions.draws for many numbers at once: md5 of a text and a number, as array arithmetic."""

from __future__ import annotations

from hashlib import md5

import numpy as np

#: Numbers hashed together, whose words stay in a core's cache; fewer than FEW are hashed one by one.
AT_ONCE, FEW = 8192, 600
#: A text up to this length is one md5 block.
ONE_BLOCK = 55
_SHIFTS = [s for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in turn * 4]
_SINES = [int(abs(np.sin(i + 1)) * 2 ** 32) for i in range(64)]


def _word(i: int) -> int:
    """The message word that step i reads."""
    return (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16


def _of_length(lead: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """First 52 bits of the md5 of lead and each number of so many decimal digits."""
    size = len(lead) + digits
    block = bytearray(lead + b"\0" * digits + b"\x80" + b"\0" * (ONE_BLOCK - size) + (8 * size).to_bytes(8, "little"))
    fixed = np.frombuffer(bytes(block), "<u4").tolist()
    own: dict[int, np.ndarray] = {}
    rest = numbers
    for at in range(size - 1, len(lead) - 1, -1):
        rest, digit = rest // 10, rest % 10
        part = (digit + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
        own[at // 4] = own[at // 4] | part if at // 4 in own else part | np.uint32(fixed[at // 4])
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(len(numbers), v, np.uint32) for v in start)
    f, high = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:  # (b & c) | (~b & d)
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:  # (d & b) | (~d & c)
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = _word(i)
        if word in own:
            f += own[word]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + fixed[word]) % 2 ** 32)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=high)
        f <<= np.uint32(_SHIFTS[i])
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    first, second = ((x + np.uint32(v)).byteswap().astype(np.uint64) for x, v in zip((a, b), start))
    return ((first << np.uint64(32)) | second) >> np.uint64(12)


def hashed(lead: bytes, numbers: np.ndarray) -> np.ndarray:
    """First 52 bits of md5(lead + number) for each number from 0 on: draw_bits of parts that end in the number."""
    out = np.empty(len(numbers), np.uint64)
    for start in range(0, len(numbers), AT_ONCE):
        part = numbers[start:start + AT_ONCE].astype(np.int64)
        digits = np.maximum(np.searchsorted(10 ** np.arange(1, 19), part, side="right") + 1, 1)
        mine = out[start:start + AT_ONCE]
        for k in np.unique(digits).tolist():
            at = np.flatnonzero(digits == k)
            if len(lead) + k <= ONE_BLOCK and len(at) >= FEW:
                mine[at] = _of_length(lead, part[at], k)
            else:
                made = b"".join([md5(lead + b"%d" % i).digest() for i in part[at].tolist()])
                mine[at] = np.frombuffer(made, ">u8")[::2].astype(np.uint64) >> np.uint64(12)
    return out
