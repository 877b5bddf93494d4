"""Two-stage suffix sorting of byte blocks, on whole arrays.

Only suffixes that are smaller than their successor are sorted directly, by eight bytes at
a time among those still tied. The rest are induced by one scan over the byte buckets:
each suffix, in order, hands its predecessor to that predecessor's bucket.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each place, whether its suffix is smaller than the next one. The last is not:
    what follows the end counts as smallest."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differs = np.flatnonzero(text[1:] != text[:-1])
    ahead = np.searchsorted(differs, np.arange(n - 1))
    inside = ahead < len(differs)
    at = differs[np.minimum(ahead, max(len(differs) - 1, 0))] if len(differs) else np.zeros(n - 1, np.int64)
    out[:-1] = inside & (text[np.minimum(at, n - 2)] < text[np.minimum(at + 1, n - 1)])
    return out


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, zeros after the end; one more place."""
    padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    out = padded[: len(text) + 1] << np.uint64(56)
    for k in range(1, 8):
        out |= padded[k : len(text) + 1 + k] << np.uint64(56 - 8 * k)
    return out


def sort_direct(key: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of their suffixes' first `depth` bytes (to the next multiple
    of eight); suffixes that agree so far stay in order of place. key is eight_bytes()."""
    if len(places) < 2:
        return places
    order = places[np.argsort(key[places], kind="stable")]
    first = key[order]
    same = np.append(False, first[1:] == first[:-1])
    at = np.flatnonzero(same | np.append(same[1:], False))
    done = 8
    while done < depth and len(at):
        # Tied runs are contiguous in `at`; only runs whose next words differ are sorted.
        mine = order[at]
        tied = same[at]
        words = key[np.minimum(mine + done, len(key) - 1)]
        group = np.cumsum(~tied)
        differ = np.append(False, words[1:] != words[:-1]) & tied
        if differ.any():
            moved = np.zeros(group[-1] + 1, bool)
            moved[group[differ]] = True
            some = np.flatnonzero(moved[group])
            ranked = some[np.lexsort((words[some], group[some]))]
            order[at[some]] = mine[ranked]
            words[some] = words[ranked]
            same[at] = np.append(False, words[1:] == words[:-1]) & tied
            at = at[same[at] | np.append(same[at][1:], False)]
        done += 8
    return order


def suffix_array(text: np.ndarray, depth: int, key: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in order, exact to `depth` bytes at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(text)
    direct = sort_direct(eight_bytes(text) if key is None else key, np.flatnonzero(small), depth)
    sizes = np.bincount(text, minlength=256)
    begins = np.cumsum(sizes) - sizes
    out = np.empty(n, np.int64)
    # In a byte's bucket the induced suffixes come first, those sorted directly last.
    directs = np.split(direct, np.cumsum(np.bincount(text[direct], minlength=256))[:-1])
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))  # follows the empty suffix, the smallest

    def hand_over(block: np.ndarray, byte: int) -> np.ndarray:
        """Give predecessors that are to be induced to their buckets; return those of this byte."""
        before = block[block > 0] - 1
        before = before[~small[before]]
        kinds = text[before]
        ranked = np.argsort(kinds, kind="stable")
        before, kinds = before[ranked], kinds[ranked]
        cuts = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])) if len(kinds) else []
        own = before[:0]
        for a, b in zip(cuts, [*cuts[1:], len(kinds)]):
            if kinds[a] == byte:
                own = before[a:b]
            else:
                waiting[kinds[a]].append(before[a:b])
        return own

    for byte in np.flatnonzero(sizes).tolist():
        at, queue = begins[byte], waiting[byte]
        while queue:
            block = np.concatenate(queue)
            out[at : at + len(block)] = block
            at += len(block)
            own = hand_over(block, byte)
            queue = [own] if len(own) else []
        if len(directs[byte]):
            out[at : at + len(directs[byte])] = directs[byte]
            hand_over(directs[byte], byte)
    return out


def repeated_starts(text: np.ndarray, owner_end: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes from each place occur from another place too.

    owner_end is the end of the string that a place belongs to: strings do not run on.
    """
    n = len(text)
    out = np.zeros(n, bool)
    whole = np.arange(n) + length <= owner_end
    if not whole.any():
        return out
    key = eight_bytes(text)
    order = suffix_array(text, length, key)
    order = order[whole[order]]
    if len(order) < 2:
        return out
    # Adjacent common prefixes, as far as they matter: whether they reach `length`. The
    # last eight bytes may overlap those before them.
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]:
        live = live[key[a[live] + k] == key[b[live] + k]]
    if length < 8:
        live = live[(key[a] >> np.uint64(64 - 8 * length)) == (key[b] >> np.uint64(64 - 8 * length))]
    out[a[live]] = True
    out[b[live]] = True
    return out
