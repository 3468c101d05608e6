"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries.

Multikey quicksort partitions on one byte at a time and is fast while prefixes are short. Groups that
still agree at the shallow depth have long common prefixes, which it would walk byte by byte; these go
into a blind trie, which branches only on the bytes where strings differ and compares each new string
once, with one leaf.
"""

from __future__ import annotations

from collections.abc import Sequence


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _byte(s: bytes, d: int) -> int:
    return s[d] if d < len(s) else -1


class BlindTrie:
    """An inner node is [depth, {byte: child}], a leaf is a list of equal strings' indices under the
    key of the first; -1 stands for the end of a string."""

    def __init__(self, strings: Sequence[bytes]) -> None:
        self.s, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.s[i]
        if self.root is None:
            self.root = (i, [i])
            return
        node = self.root
        while isinstance(node, list):
            kids = node[1]
            node = kids.get(_byte(s, node[0])) or next(iter(kids.values()))
        other = self.s[node[0]]
        lcp = common_prefix(s, other)
        if lcp == len(s) == len(other):
            node[1].append(i)
            return
        up, key, node = None, None, self.root
        while isinstance(node, list) and node[0] < lcp:
            up, key = node, _byte(s, node[0])
            node = node[1][key]
        leaf = (i, [i])
        if isinstance(node, list) and node[0] == lcp:
            node[1][_byte(s, lcp)] = leaf
            return
        split = [lcp, {_byte(other, lcp): node, _byte(s, lcp): leaf}]
        if up is None:
            self.root = split
        else:
            up[1][key] = split

    def walk(self, lcp: int, order: list[int], lcps: list[int]) -> None:
        """Appends the indices in order; each one's common prefix with the one before it, the first's
        being ``lcp``."""
        stack = [(self.root, lcp)]
        while stack:
            node, l = stack.pop()  # noqa: E741
            if isinstance(node, list):
                kids = sorted(node[1].items())
                stack.extend((c, node[0]) for _, c in reversed(kids[1:]))
                stack.append((kids[0][1], l))
            else:
                i, same = node
                order.extend(same)
                lcps.append(l)
                lcps.extend([len(self.s[i])] * (len(same) - 1))


def deep_shallow_sort(strings: Sequence[bytes], start: int = 0, shallow: int = 16) -> tuple[list[int], list[int]]:
    """(order, lcps) of strings that agree in their first ``start`` bytes; the first lcp is -1. The
    quicksort looks at ``shallow`` bytes from there on."""
    order: list[int] = []
    lcps: list[int] = []
    deep = start + shallow
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), start, -1)]  # group, depth, lcp with what is before
    while stack:
        group, d, before = stack.pop()
        if not group:
            continue
        if len(group) == 1:
            order.append(group[0])
            lcps.append(before)
        elif d >= deep:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            trie.walk(before, order, lcps)
        else:
            pivot = _byte(strings[group[len(group) // 2]], d)
            less, same, more = [], [], []
            for i in group:
                c = _byte(strings[i], d)
                (same if c == pivot else less if c < pivot else more).append(i)
            if more:
                stack.append((more, d, d if less or same else before))
            if pivot < 0:  # all ended: equal strings
                if less:
                    stack.append((less, d, before))
                order.extend(same)
                lcps.extend([before, *[d] * (len(same) - 1)])
                continue
            if same:
                stack.append((same, d + 1, d if less else before))
            if less:
                stack.append((less, d, before))
    return order, lcps
