"""Permutations of rows that are never gathered: a keyed bijection says where each row goes.

The numbers from 0 to n - 1 are permuted by a Feistel network over a few more numbers than n; one that lands beyond n goes through it again until it does not. Any task can
work out the place of any row from its number, n and the key of the permutation.
"""

from __future__ import annotations

import math

import numpy as np

U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _A
    x = (x ^ (x >> U(29))) * _B
    return x ^ (x >> U(32))


def round_keys(seed: int, names: list[int], rounds: int = 16) -> np.ndarray:
    """[rounds, names] keys; ``names`` number the permutations of one seed."""
    start = _mixed(np.array([seed & (2**64 - 1)], U) + _A)
    return _mixed(_mixed(start + np.array(names, U) * _B) + np.arange(1, rounds + 1, dtype=U)[:, None] * _A)


def _network(x: np.ndarray, keys: np.ndarray, high: int, low: int) -> np.ndarray:
    """One pass: the left half of a number (``high`` bits, then ``low``, and so on) takes in a hash of the right half and the round's key, and the halves change places."""
    for key in keys:
        right = x & U((1 << low) - 1)
        f = (right * _A + key) * _B
        f = ((f ^ (f >> U(32))) * _A) >> U(64 - high)
        x = right << U(high) | ((x >> U(low)) ^ f)
        high, low = low, high
    return x


def _shares(left: np.ndarray, right: np.ndarray, keys: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for numbers left * b + right below a * b: a hash of one half is added to the other, modulo its size, in turn."""
    for r, key in enumerate(keys):
        other, size = (left, b) if r % 2 else (right, a)
        f = other * _A + key
        f *= _B
        f ^= f >> U(32)
        f *= _A
        f >>= U(32)
        f *= U(size)
        f >>= U(32)  # below the size
        f += right if r % 2 else left
        np.minimum(f, f - U(size), out=f)  # less the size where that is not below zero
        left, right = (left, f) if r % 2 else (f, right)
    return left, right


def places(i: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Where each row goes: of every number in ``i`` (below n) its place in each permutation, [numbers, columns of ``keys``]. Each column is a permutation of all n numbers."""
    shape = len(i), keys.shape[1]
    bits = max(8, int(n - 1).bit_length())
    if bits < 12:  # few numbers: many rounds over bits
        again = lambda x, keys: _network(x, keys, bits // 2, bits - bits // 2)
        out = again(np.repeat(i.astype(U)[:, None], shape[1], axis=1), keys[:, None, :])
    else:  # about n = a * b, so that hardly any number lands beyond
        a = math.isqrt(n - 1) + 1
        b, keys = -(-n // a), keys[:6]

        def again(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
            left, right = _shares(x // U(b), x % U(b), keys, a, b)
            return left * U(b) + right

        out = again(i.astype(U)[:, None], keys[:, None, :])
    out = out.ravel()
    at = np.flatnonzero(out >= U(n))
    while len(at):
        out[at] = again(out[at], keys[:, at % shape[1]])
        at = at[out[at] >= U(n)]
    return out.reshape(shape).astype(np.int64)
