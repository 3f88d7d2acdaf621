"""Order of windows of bytes by two-stage suffix sorting, and the anchors that bring equal windows together."""

from __future__ import annotations

import numpy as np

from .common import mix

#: Bytes of the gram that names a window, and of bytes in one numpy step.
GRAM, STEP = 32, 1 << 22
#: Low bits of a packed gram hash that hold its place.
PLACE = np.uint64((1 << 24) - 1)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as big-endian numbers. data needs 7 bytes more than places."""
    return np.ndarray(max(len(data) - 7, 0), ">u8", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(place, first window, last window, hash): the places whose gram has the least hash in some window of `length`
    bytes of one row, with the windows it is least in. A window is named by its start and has one anchor, the leftmost of
    least hash, so equal windows have equal grams at equal distances from their starts."""
    ahead = length - GRAM + 1  # grams of a window
    found = []
    for at in range(0, max(len(data) - length + 1, 0), STEP):
        seg = data[at:at + STEP + length - 1]
        lanes = words_at(seg) * np.uint64(0x9E3779B97F4A7C15)
        lanes ^= lanes >> np.uint64(29)
        n = len(seg) - GRAM + 1
        h = lanes[:n] * np.uint64(0xBF58476D1CE4E5B9)
        for j, c in ((8, 0x94D049BB133111EB), (16, 0xD6E8FEB86659FD93), (24, 0xA0761D6478BD642F)):
            h += lanes[j:j + n] * np.uint64(c)
            h ^= h >> np.uint64(31)
        h = mix(h)
        least, span = (h & ~PLACE) | np.arange(n, dtype=np.uint64), 1
        while span * 2 <= ahead:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        windows = n - ahead + 1
        least = np.minimum(least[:windows], least[ahead - span:ahead - span + windows])
        place = (least & PLACE).astype(np.int64)
        whole = np.zeros(windows + 1, np.int32)  # windows that lie in one row
        ends = np.maximum(offsets[1:] - length + 1, offsets[:-1])
        np.add.at(whole, np.clip(offsets[:-1] - at, 0, windows), 1)
        np.add.at(whole, np.clip(ends - at, 0, windows), -1)
        valid = np.cumsum(whole[:-1]) > 0
        starts = np.flatnonzero(valid)
        if not len(starts):
            continue
        p = place[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        found.append((p[first] + at, starts[first] + at, starts[last] + at, h[p[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def window_order(data: np.ndarray, starts: np.ndarray, lasts: np.ndarray, length: int) -> np.ndarray:
    """Places starts[i]..lasts[i] of all i in the order of the `length` bytes from there on.

    Two stages. A suffix is falling if it is greater than its successor, else rising. Rising ones are sorted directly;
    falling ones are induced: going through the buckets of first bytes in rising order, each suffix in its final place
    puts its falling predecessor next in the predecessor's bucket, where falling ones stand before rising ones. Beyond
    lasts[i], places up to the next rising one are taken along, since the falling ones before need them.
    """
    n = len(data)
    text = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    # rising or falling is settled by the next byte that differs
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    to = change[np.searchsorted(change, np.arange(n))]
    falling = text[to] > text[np.minimum(to + 1, len(text) - 1)]
    wanted = np.zeros(n + 1, np.int32)
    np.add.at(wanted, starts, 1)
    stop = np.append(np.flatnonzero(~falling), n - 1)
    ends = stop[np.searchsorted(stop, lasts)]
    np.add.at(wanted, np.minimum(ends, n - 1) + 1, -1)
    wanted = np.cumsum(wanted[:n]) > 0
    wanted[n - 1] |= falling[n - 1] and wanted[n - 1]

    rising = np.flatnonzero(wanted & ~falling)
    keys = np.lib.stride_tricks.sliding_window_view(text, length)[rising]
    keys = np.ascontiguousarray(keys).view(f"S{length}").reshape(-1)
    rising = rising[np.argsort(keys, kind="stable")]
    del keys
    bounds = np.searchsorted(text[rising], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and wanted[n - 1] and falling[n - 1]:  # the last suffix, before the empty one
        queue[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        layer = np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int64)
        bucket = []
        while len(layer):  # falling, and those that precede them with the same byte
            bucket.append(layer)
            before = layer[layer > 0] - 1
            layer = before[(text[before] == c) & wanted[before] & falling[before]]
        bucket.append(rising[bounds[c]:bounds[c + 1]])
        done = np.concatenate(bucket)
        out.append(done)
        before = done[done > 0] - 1
        before = before[(text[before] > c) & wanted[before]]
        kinds = text[before]
        by = np.argsort(kinds, kind="stable")
        before, kinds = before[by], kinds[by]
        for k in np.unique(kinds):
            queue[k].append(before[np.searchsorted(kinds, k):np.searchsorted(kinds, k, "right")])
    order = np.concatenate(out)
    asked = np.zeros(n + 1, np.int32)
    np.add.at(asked, starts, 1)
    np.add.at(asked, lasts + 1, -1)
    return order[np.cumsum(asked[:n])[order] > 0]


def equal_to_previous(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of the order has its whole length in common with the one before it."""
    same = np.zeros(len(order), bool)
    words = words_at(np.concatenate([data, np.zeros(8, np.uint8)]))
    left = np.arange(1, len(order))
    for j in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        left = left[words[order[left] + j] == words[order[left - 1] + j]]
    same[left] = True
    return same
