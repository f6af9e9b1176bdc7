"""The 64-bit Mersenne Twister and a shuffle with bounded draws, as the C++ standard library of GCC does it."""

from __future__ import annotations

# Fixed values of mt19937_64 in the C++ standard.
_N, _M = 312, 156
_MATRIX = 0xB5026F5AA96619E9
_UPPER, _LOWER = 0xFFFFFFFF80000000, 0x7FFFFFFF
_U, _D = 29, 0x5555555555555555
_S, _B = 17, 0x71D67FFFEDA60000
_T, _C = 37, 0xFFF7EEE000000000
_L = 43
_F = 6364136223846793005
_MASK = (1 << 64) - 1


class Twister64:
    def __init__(self, seed: int):
        state = [seed & _MASK]
        for i in range(1, _N):
            state.append(_F * (state[-1] ^ state[-1] >> 62) + i & _MASK)
        self.state, self.at = state, _N

    def __call__(self) -> int:
        if self.at == _N:
            s = self.state
            for i in range(_N):
                y = s[i] & _UPPER | s[(i + 1) % _N] & _LOWER
                s[i] = s[(i + _M) % _N] ^ y >> 1 ^ (_MATRIX if y & 1 else 0)
            self.at = 0
        y = self.state[self.at]
        self.at += 1
        y ^= y >> _U & _D
        y ^= y << _S & _B
        y ^= y << _T & _C
        return y ^ y >> _L

    def below(self, n: int) -> int:
        """A draw in 0 .. n - 1 by multiplying and keeping the high word, low words under the bias threshold refused."""
        product = self() * n
        if product & _MASK < n:
            least = (-n & _MASK) % n
            while product & _MASK < least:
                product = self() * n
        return product >> 64


def shuffled(items: list, source: Twister64) -> list:
    """The items shuffled: swaps from front to back, two of them from one draw."""
    out, n = list(items), len(items)
    if n < 2:
        return out
    at = 1
    if n % 2 == 0:
        j = source.below(2)
        out[1], out[j] = out[j], out[1]
        at = 2
    while at < n:
        first, second = divmod(source.below((at + 1) * (at + 2)), at + 2)
        out[at], out[first] = out[first], out[at]
        out[at + 1], out[second] = out[second], out[at + 1]
        at += 2
    return out
