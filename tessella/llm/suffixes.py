"""Suffix arrays by two-stage sorting, and the repeated windows that they show."""

from __future__ import annotations

import numpy as np

from tessella.llm.common import SpanHash

#: Signs in one 63-bit word of nine bits each.
PACK = 7
#: Neighbours in order that are compared at once.
ROWS = 2048


def _hashes(text: np.ndarray, places: np.ndarray, depth: int, hasher: SpanHash) -> np.ndarray:
    """Hashes of the depth bytes from each place on, or of those up to the end."""
    return hasher.of(hasher.totals(text), places, np.minimum(places + depth, len(text)))


def _packed(signs: np.ndarray, room: int) -> np.ndarray:
    """For each place the next PACK signs as one number; zero (the end sign) after the text."""
    wide = np.concatenate([signs, np.zeros(room + PACK, signs.dtype)]).astype(np.int64)
    out = np.zeros(len(signs) + room, np.int64)
    for i in range(PACK):
        out <<= 9
        out |= wide[i : i + len(out)]
    return out


def _smaller_than_next(signs: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last sign is the unique least one."""
    step = np.sign(np.diff(signs.astype(np.int32)))  # of each place to the next
    place = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    nearest = np.minimum.accumulate(place[::-1])[::-1]  # the next place where the sign changes
    return np.append(step[nearest] > 0, False)


def _sorted_directly(number: np.ndarray, place: np.ndarray, packed: np.ndarray, depth: int) -> np.ndarray:
    """Numbers in order of the first depth signs of the suffixes at their places, word by word within groups that still tie."""
    order = number[np.argsort(packed[place], kind="stable")]
    key = packed[place[order]]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    for at in range(PACK, depth, PACK):
        group = np.cumsum(new)
        tied = np.zeros(len(order), bool)
        tied[:-1] = ~new[1:]
        tied |= ~new
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        group, here = group[rows], order[rows]
        key = packed[place[here] + at]
        by = np.lexsort((key, group))
        order[rows], key = here[by], key[by]
        split = np.ones(len(rows), bool)
        split[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[rows] = split
    return order


def _classes(places: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each class of equal values, and each place's class."""
    _, at, group = np.unique(value, return_index=True, return_inverse=True)
    return places[at], group


def suffix_array(text: np.ndarray, depth: int, hasher: SpanHash) -> np.ndarray:
    """All places of a byte text in order of their suffixes' first depth bytes.

    Suffixes smaller than their successors are sorted directly. Each other suffix is its first sign before a
    smaller suffix, so a scan from the least bucket upward appends it to its own bucket in the right order;
    the scan goes bucket by bucket, with equal neighbours in the same bucket found in rounds.
    """
    signs = np.append(text.astype(np.int16) + 1, 0).astype(np.int16)
    packed = _packed(signs, depth + PACK)
    smaller = _smaller_than_next(signs)
    # suffixes that are equal up to depth are sorted as one
    places = np.flatnonzero(smaller)
    one, group = _classes(places, _hashes(text, places, depth, hasher))
    rank = np.empty(len(one), np.int64)
    by = _sorted_directly(np.arange(len(one)), one, packed, depth)
    rank[by] = np.arange(len(one))
    direct = places[np.argsort(rank[group], kind="stable")]
    borders = np.searchsorted(signs[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    waiting[0].append(np.array([len(text)]))
    out = []
    for sign in range(257):
        queue = waiting[sign]
        i = 0
        while i < len(queue):  # what stands before a suffix of this bucket may belong to this bucket itself
            before = queue[i] - 1
            before = before[before >= 0]
            before = before[(signs[before] == sign) & ~smaller[before]]
            if len(before):
                queue.append(before)
            i += 1
        bucket = np.concatenate([*queue, direct[borders[sign] : borders[sign + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[signs[before] > sign]
        if len(before):
            to = signs[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            for part in np.split(before, np.flatnonzero(np.diff(to)) + 1):
                waiting[signs[part[0]]].append(part)
        waiting[sign] = []
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, text: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place's suffix shares with the one before it in order, up to depth (0 for the first)."""
    shared = np.zeros(len(order), np.int64)
    wide = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(depth, text.dtype)), depth)
    left = len(text) - order
    for a in range(1, len(order), ROWS):
        here, before = order[a : a + ROWS], order[a - 1 : a - 1 + ROWS][: len(order) - a]
        differs = wide[here] != wide[before]
        most = np.minimum(np.minimum(left[a : a + ROWS], left[a - 1 : a - 1 + ROWS][: len(order) - a]), depth)
        shared[a : a + ROWS] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), depth), most)
    return shared


def repeated(text: np.ndarray, valid: np.ndarray, weight: np.ndarray, depth: int, hasher: SpanHash) -> np.ndarray:
    """For each place, whether it is valid and its next depth bytes also start at another valid place.

    weight tells how many occurrences a place stands for.
    """
    order = suffix_array(text, depth, hasher)
    order = order[order < len(text)]
    order = order[valid[order]]
    out = np.zeros(len(text), bool)
    if len(order):
        group = np.cumsum(common_prefixes(order, text, depth) < depth) - 1
        out[order] = np.bincount(group, weight[order])[group] > 1
    return out
