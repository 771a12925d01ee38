"""Similarities that Catalyst has no expression for, as Arrow-batched UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.folding import canonical_text as canonical
from ledgerlens.functions.folding import match_text as matchable


def common_with(a: str):
    """A function of ``b``: the length of the longest common subsequence of ``a`` and ``b``, bit-parallel."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1

    def common(b: str) -> int:
        state = full
        for ch in b:
            hit = state & masks.get(ch, 0)
            state = ((state + hit) | (state - hit)) & full
        return len(a) - state.bit_count()

    return common


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length)."""
    if not a and not b:
        return 100.0
    return 200.0 * common_with(a)(b) / (len(a) + len(b))


def best_window(value: str | None, forms: list[str], split: bool = False) -> tuple[float, int | None, int | None]:
    """(indel ratio, start, words) of the window that is most like ``value``: the shortest, then first of the best.

    With ``split``, a form that holds spaces (a word with a line break inside) is as long
    as its parts, and a window without such a form goes before an equally long one with it.

    ``forms`` are all words of a text, each in its ``matchable`` form. A window has at
    most as many characters in common with the value as its words have one by one and a
    space between each two, so windows are compared from the best such bound down, until
    no bound reaches the best ratio found: the result is that of comparing all.
    """
    needle = matchable(value) or ""
    top: tuple[float, int | None, int | None] = (0.0, None, None)
    if not needle or not forms:
        return top
    common = common_with(needle)
    known = {w: (common(w), len(w), 1 if w else 0) for w in set(forms)}
    sums = np.zeros((len(forms) + 1, 3), np.int64)
    np.cumsum(np.array([known[w] for w in forms], np.int64), axis=0, out=sums[1:])
    bounds, starts, sizes = [], [], []
    for n in range(1, min(len(needle.split()) + 2, 8, len(forms)) + 1):
        shared, chars, full = (sums[n:] - sums[:-n]).T
        at = np.flatnonzero(full)
        gaps = full[at] - 1
        bounds.append(200.0 * np.minimum(shared[at] + gaps, len(needle)) / (chars[at] + gaps + len(needle)))
        starts.append(at)
        sizes.append(np.full(len(at), n))
    bound, start, size = (np.concatenate(x) for x in (bounds, starts, sizes))
    rank: tuple[int, ...] = ()
    for i in np.lexsort((start, size, -bound)):
        if bound[i] <= 0 or bound[i] < top[0]:
            break
        at, n = int(start[i]), int(size[i])
        parts = [w for w in forms[at : at + n] if w]
        found = " ".join(parts)
        score = 200.0 * common(found) / (len(found) + len(needle))
        if score < top[0] or score == 0:
            continue
        length = found.count(" ") + 1
        key = (length, length - len(parts), n, at) if split else (n, at)
        if score > top[0] or key < rank:
            top, rank = (score, at, n), key
    return top


def token_set_ratio(a: str, b: str) -> float:
    """Indel ratio of the shared and unshared sorted words, the best of three pairings."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_a, only_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{shared} {only_a}".strip(), f"{shared} {only_b}".strip()
    best = indel_ratio(with_a, with_b)
    if shared:
        best = max(best, indel_ratio(shared, with_a), indel_ratio(shared, with_b))
    return best


def _pair_udf(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def ratio(a: Column, b: Column) -> Column:
    return _pair_udf(indel_ratio)(a, b)


def token_set(a: Column, b: Column) -> Column:
    return _pair_udf(token_set_ratio)(a, b)
