"""Deep-shallow sorting of suffixes of bounded depth."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes that multikey quicksort compares before blind tries take over.
SHALLOW = 32
#: Suffixes of one group that a blind trie orders; quicksort goes on with larger ones.
LARGE = 20_000
_BYTE_LIMITS = U(1) << np.arange(8, 64, 8, dtype=U)


def _words(data: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; places past the end hold zero."""
    w = np.zeros(len(data) + depth + 16, dtype=U)
    w[: len(data)] = data
    for shift, by in ((8, 1), (16, 2), (32, 4)):
        w[:-by] = (w[:-by] << U(shift)) | w[by:]
    return w


def _common_bytes(x: np.ndarray) -> np.ndarray:
    """Leading bytes in which two big-endian numbers with this xor (not 0) agree."""
    return 7 - np.searchsorted(_BYTE_LIMITS, x, side="right")


class _Node:
    __slots__ = ("depth", "kids", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.kids = depth, leaf, None


def _blind_trie(data: bytes, suffixes: list[int], known: int, width: int) -> tuple[list[int], list[int]]:
    """Sort suffixes that agree in `known` bytes, at most `width` bytes each; order and the common prefix with the one before.

    Inner nodes store a depth and branch by one byte there. An insertion goes
    down blindly by the branching bytes, compares once with any leaf below,
    and adds a branch where the two first differ.
    """
    root = _Node(width, suffixes[0])
    equal: dict[int, list[int]] = {suffixes[0]: [suffixes[0]]}
    for s in suffixes[1:]:
        node = root
        while node.kids is not None:
            c = data[s + node.depth]
            node = node.kids.get(c) or next(iter(node.kids.values()))
        leaf = node.leaf
        a, b = data[s + known : s + width], data[leaf + known : leaf + width]
        if a == b:
            equal[leaf].append(s)
            continue
        lo, hi = 0, len(a)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if a[:mid] == b[:mid]:
                lo = mid
            else:
                hi = mid
        split = known + lo
        equal[s] = [s]
        node, up, via = root, None, 0
        while node.kids is not None and node.depth < split:
            up, via = node, data[s + node.depth]
            node = node.kids[via]
        new = _Node(width, s)
        if node.kids is not None and node.depth == split:
            node.kids[data[s + split]] = new
            continue
        inner = _Node(split, leaf)
        inner.kids = {data[leaf + split]: node, data[s + split]: new}
        if up is None:
            root = inner
        else:
            up.kids[via] = inner
    order: list[int] = []
    common: list[int] = []
    stack: list[tuple[_Node, int]] = [(root, known)]
    while stack:
        node, lcp = stack.pop()
        if node.kids is None:
            for s in equal[node.leaf]:
                order.append(s)
                common.append(lcp)
                lcp = width
            continue
        kids = [node.kids[c] for c in sorted(node.kids)]
        stack.extend((kid, node.depth) for kid in reversed(kids[1:]))
        stack.append((kids[0], lcp))
    return order, common


def sort_suffixes(data: np.ndarray, suffixes: np.ndarray, width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes sorted by their first `width` bytes, and each one's common prefix with the one before (at most `width`).

    Shallow: multikey quicksort by eight bytes at a time, all groups at once;
    groups of one are done. Deep: groups that still agree after `shallow`
    bytes are compared as a whole with their first suffix, and those that
    differ somewhere are ordered by a blind trie.
    """
    words = _words(data, width)
    order = np.array(suffixes, dtype=np.int64)
    n = len(order)
    common = np.zeros(n, dtype=np.int64)
    group = np.zeros(n, dtype=np.int64)  # place of the group's first

    def quicksort(live: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """One step: order the places `live` by group and the next eight bytes; places still tied, and sizes of their groups."""
        w = words[order[live] + depth]
        by = np.lexsort((w, group[live]))
        w, g = w[by], group[live][by]
        order[live] = order[live][by]
        first = np.ones(len(live), dtype=bool)
        first[1:] = (w[1:] != w[:-1]) | (g[1:] != g[:-1])
        at = np.flatnonzero(first[1:] & (g[1:] == g[:-1])) + 1
        x = w[at] ^ w[at - 1]
        common[live[at]] = depth + _common_bytes(x)
        head = np.maximum.accumulate(np.where(first, np.arange(len(live)), 0))
        group[live] = live[head]
        size = np.bincount(head, minlength=len(live))[head]
        return live[size > 1], size[size > 1]

    depth, live, size = 0, np.arange(n), np.full(n, n)
    while depth + 8 <= min(shallow, width) and len(live):
        live, size = quicksort(live, depth)
        depth += 8
    raw = data.tobytes() + bytes(width + 16)
    while len(live):
        # Large groups stay with the array steps, so that no trie outgrows a task.
        large = (size > LARGE) & (depth + 8 <= width)
        _deep(raw, words, order, common, group, live[~large], depth, width)
        live = live[large]
        if len(live):
            live, size = quicksort(live, depth)
            depth += 8
    return order, np.minimum(common, width)


def _deep(raw: bytes, words: np.ndarray, order: np.ndarray, common: np.ndarray, group: np.ndarray, live: np.ndarray, depth: int, width: int) -> None:
    """Order groups that agree in `depth` bytes: at once where they agree over the whole width, pairs by one comparison, others by a blind trie."""
    if not len(live):
        return
    heads = order[group[live]]
    split = np.full(len(live), width)  # how far each agrees with the first of its group
    rest = np.arange(len(live))
    for d in range(depth, width, 8):
        x = words[order[live[rest]] + d] ^ words[heads[rest] + d]
        if width - d < 8:
            x >>= U(8 * (8 - (width - d)))
            x <<= U(8 * (8 - (width - d)))
        differ = x != 0
        split[rest[differ]] = d + _common_bytes(x[differ])
        rest = rest[~differ]
        if not len(rest):
            break
    g = group[live]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    mixed = np.minimum.reduceat(split, starts) < width
    sizes = np.diff(np.r_[starts, len(live)])
    follower = np.ones(len(live), dtype=bool)
    follower[starts] = False
    common[live[follower]] = split[follower]
    pair = starts[mixed & (sizes == 2)]
    one, two = live[pair], live[pair + 1]
    at = split[pair + 1] // 8 * 8
    swap = words[order[one] + at] > words[order[two] + at]
    order[one[swap]], order[two[swap]] = order[two[swap]], order[one[swap]]
    several = mixed & (sizes > 2)
    for s, m in zip(starts[several].tolist(), sizes[several].tolist(), strict=True):
        places = live[s : s + m]
        sorted_, lcp = _blind_trie(raw, order[places].tolist(), depth, width)
        order[places] = sorted_
        common[places[1:]] = lcp[1:]


def repeated_windows(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, extra: np.ndarray, shared: np.ndarray, width: int) -> np.ndarray:
    """At which places of these texts a window of `width` bytes begins that occurs at another place too.

    Each text is a run of windows: `classes` numbers equal runs, one after the
    other; `extra` marks second places of a run, which need no result;
    `shared` marks texts whose windows may occur in another text's class, or
    twice in one.

    First the runs with two places are sorted as suffixes. Where neighbours
    agree beyond a window, the windows that follow agree as well and are taken
    over without being sorted. The rest are then sorted one by one, together
    with all windows that they may equal.
    """
    found = np.zeros(len(data) + 1, dtype=bool)
    size = np.diff(offsets)
    two = np.flatnonzero(np.bincount(classes, minlength=1)[classes] > 1)
    if len(two):
        order, common = sort_suffixes(data, offsets[two], width)
        text = np.searchsorted(offsets, order, side="right") - 1
        room = np.minimum(size[text[1:]], size[text[:-1]])
        reach = np.minimum(common[1:], room)
        live = np.flatnonzero((common[1:] >= width) & (room >= width))
        words = _words(data, 8)
        while len(live):  # eight bytes further at a time
            a, b = order[live] + reach[live], order[live + 1] + reach[live]
            gain = np.minimum(np.where(words[a] == words[b], 8, _common_bytes(words[a] ^ words[b])), room[live] - reach[live])
            reach[live] += gain
            live = live[(gain == 8) & (reach[live] < room[live])]
        far = np.zeros(len(order), dtype=np.int64)
        far[1:] = reach
        far[:-1] = np.maximum(far[:-1], reach)
        mine = (far >= width) & ~extra[text]
        edge = np.zeros(len(found) + 1, dtype=np.int64)
        np.add.at(edge, order[mine], 1)
        np.add.at(edge, order[mine] + far[mine] - width + 1, -1)
        found |= np.cumsum(edge)[:-1] > 0
    place = np.arange(len(data))
    owner = np.repeat(np.arange(len(size)), size)
    window = place + width <= np.repeat(offsets[1:], size)
    window &= (shared & ~extra)[owner]
    if (window & ~found[:-1]).any():
        at = place[window]
        found[at] |= repeated_suffixes(data, at, width)
    return found


def repeated_suffixes(data: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Which windows of `width` bytes are equal to another: neighbours in sorted order that agree over the whole width."""
    found = np.zeros(len(windows), dtype=bool)
    if len(windows) < 2:
        return found
    order, common = sort_suffixes(data, windows, width)
    full = common >= width
    full[0] = False
    hit = full.copy()
    hit[:-1] |= full[1:]
    found[np.searchsorted(windows, order[hit])] = True
    return found
