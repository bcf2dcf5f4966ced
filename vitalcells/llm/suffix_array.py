"""Enhanced suffix arrays of short texts, and the maximal repeats they show.

All suffixes of a block of texts are sorted, neighbours are compared (the common-prefix array), and
one scan with a stack lists the intervals of the common-prefix tree. An interval whose suffixes are
preceded by different bytes cannot be extended to the left: it is a maximal repeat, and the suffixes
of the interval are all its occurrences.
"""

from dataclasses import dataclass

import numpy as np

from vitalcells.llm.textbytes import Hasher, mix


@dataclass
class SuffixArray:
    """Suffixes in order within their groups; prefix[i] is what suffixes i and i + 1 share."""

    positions: np.ndarray
    owners: np.ndarray
    prefix: np.ndarray


def build(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, groups: np.ndarray,
          least: int) -> SuffixArray:
    """Suffixes of texts data[starts[i]:ends[i]] that are at least `least` long and share that much
    with another suffix of the same group. Those that share less begin no repeat and are left out
    before the sort, told by a hash of their first bytes."""
    count = np.maximum(ends - starts - least + 1, 0)
    owners = np.repeat(np.arange(len(starts)), count)
    firsts = np.cumsum(count) - count
    positions = starts[owners] + (np.arange(len(owners)) - firsts[owners])
    if len(positions):
        hashes = Hasher(data, False).ranges(positions, positions + least)
        hashes = mix(hashes ^ mix(groups[owners].view(np.uint64)))
        order = np.argsort(hashes, kind="stable")
        sorted_hashes = hashes[order]
        same = sorted_hashes[1:] == sorted_hashes[:-1]
        again = np.zeros(len(order), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        positions, owners = positions[again], owners[again]
    n = len(positions)
    if n < 2:
        return SuffixArray(positions, owners, np.zeros(0, np.int64))

    left = ends[owners] - positions
    width = int(left.max())
    padded = np.zeros(len(data) + width + 16, np.uint8)
    padded[:len(data)] = data
    words = np.zeros(len(data) + width + 8, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i:i + len(words)]
    columns = []
    for j in range(0, width, 8):
        rest = np.clip(8 - (left - j), 0, 8)
        cut = (np.minimum(rest, 7) * 8).astype(np.uint64)
        column = (words[positions + j] >> cut) << cut
        column[rest == 8] = 0
        columns.append(column)
    order = np.lexsort([left, *columns[::-1], groups[owners]])
    positions, owners, left = positions[order], owners[order], left[order]

    group = groups[owners]
    alive = group[1:] == group[:-1]
    prefix = np.zeros(n - 1, np.int64)
    for column in columns:
        column = column[order]
        differ = column[1:] ^ column[:-1]
        equal = differ == 0
        prefix[alive & equal] += 8
        stop = np.flatnonzero(alive & ~equal)
        for bits in range(56, 0, -8):
            prefix[stop] += differ[stop] < np.uint64(1 << bits)
        alive &= equal
    return SuffixArray(positions, owners, np.minimum(prefix, np.minimum(left[1:], left[:-1])))


def intervals(prefix: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last suffix and common length of every interval of the common-prefix tree."""
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    # Entries below the least length only close what is open.
    previous = -1
    at = np.flatnonzero(prefix >= least)
    for i, value in zip(at.tolist(), prefix[at].tolist()):
        if i != previous + 1:
            while stack:
                length, first = stack.pop()
                found.append((first, previous + 1, length))
        first = i
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            found.append((first, i, length))
        if not stack or stack[-1][0] < value:
            stack.append((value, first))
        previous = i
    while stack:
        length, first = stack.pop()
        found.append((first, previous + 1, length))
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def runs_of_least(prefix: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The topmost intervals: where each begins, and the interval of every suffix."""
    fresh = np.append(True, prefix < least)
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def maximal_intervals(data: np.ndarray, starts: np.ndarray, array: SuffixArray,
                      least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last suffix and length of all maximal repeats of `least` bytes or more.

    The suffixes from first to last are a repeat's occurrences. A text's first suffix counts as preceded
    by a byte of its own, since what stands before it is not known.
    """
    first, last, length = intervals(array.prefix, least)
    if not len(first):
        return first, last, length
    opening = array.positions == starts[array.owners]
    before = data[np.maximum(array.positions - 1, 0)].astype(np.int64)
    differs = (before[1:] != before[:-1]) | opening[1:] | opening[:-1]
    changes = np.concatenate([[0], np.cumsum(differs)])
    diverse = changes[last] > changes[first]
    return first[diverse], last[diverse], length[diverse]
