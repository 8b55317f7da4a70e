"""Sorting long strings with their common prefixes: multikey quicksort, then blind tries."""

from __future__ import annotations

import numpy as np

WORD = 8
SHALLOW = 2


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Members in the order of their strings, and each one's common prefix with the one before (the first: 0).

    An inner node is (depth, children by the byte at that depth; -1: the string
    ends). A string goes down by its bytes at the nodes' depths alone, is
    compared once with the string it arrives at, and branches off at the depth
    that comparison gives.
    """
    root: list | tuple = (members[0],)  # a leaf: the members of one string
    for m in members[1:]:
        s = strings[m]
        n = len(s)
        node = root
        while type(node) is list:
            at = node[0]
            child = node[1].get(s[at] if at < n else -1)
            node = next(iter(node[1].values())) if child is None else child
        other = strings[node[0]]
        same = common_prefix(s, other)
        if same == n == len(other):
            whole = (*node, m)
            if root is node:
                root = whole
                continue
        else:
            whole = (m,)
        parent, mark, node = None, None, root
        while type(node) is list and node[0] < same:
            parent, mark = node, (s[node[0]] if node[0] < n else -1)
            node = node[1][mark]
        if len(whole) > 1:
            while type(node) is list:
                parent, mark = node, (s[node[0]] if node[0] < n else -1)
                node = node[1][mark]
            parent[1][mark] = whole
        elif type(node) is list and node[0] == same:
            node[1][s[same] if same < n else -1] = whole
        else:
            split = [same, {(other[same] if same < len(other) else -1): node, (s[same] if same < n else -1): whole}]
            if parent is None:
                root = split
            else:
                parent[1][mark] = split
    order, shared, stack = [], [], [(root, 0)]
    while stack:
        node, before = stack.pop()
        if type(node) is list:
            marks = sorted(node[1])
            stack.extend((node[1][c], node[0]) for c in reversed(marks[1:]))
            stack.append((node[1][marks[0]], before))
        else:
            order.extend(node)
            shared.append(before)
            shared.extend([len(strings[node[0]])] * (len(node) - 1))
    return order, shared


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and each one's common prefix with the one before it in that order (the first: 0).

    The shallow phase is a multikey quicksort with eight-byte characters: sort by
    the first, then only groups of equal ones by the next. Strings that still
    agree after ``SHALLOW`` characters are ordered by blind tries.
    """
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = b"".join([s[: WORD * SHALLOW].ljust(WORD * SHALLOW, b"\0") for s in strings])
    words = np.frombuffer(head, ">u8").reshape(n, SHALLOW).astype(np.uint64)
    order, group = np.argsort(words[:, 0], kind="stable"), np.zeros(n, np.int64)
    for depth in range(SHALLOW):
        if depth:
            order = order[np.lexsort((words[order, depth], group))]
        w = words[order, depth]
        new = np.append(False, (w[1:] != w[:-1]) | (group[1:] != group[:-1]))
        group = np.cumsum(new)
    starts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), n)
    shared = np.zeros(n, np.int64)
    listed = order.tolist()
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if hi - lo > 1:
            listed[lo:hi], shared[lo:hi] = blind_trie(strings, listed[lo:hi])
        if lo:
            shared[lo] = common_prefix(strings[listed[lo - 1]], strings[listed[lo]])
    return np.array(listed), shared
