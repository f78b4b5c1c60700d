"""Signature trees: nodes hold OR-combined token bitmaps and size ranges; a dual traversal finds close pairs.

A bit that every member of one node has and no member of the other stands for a shingle outside the
intersection, so it lowers the largest possible overlap of any two members.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from basketlens.llm.shingles import folded

FANOUT = 8
#: Bits outside that stand for one more shingle outside than they show, among likely pairs.
LIKELY = 1.15


def linked(inter, left, right):
    """The similarity rule: 100 * intersection >= 80 * union, of nonempty sets."""
    return (inter > 0) & (100 * inter >= 80 * (left + right - inter))


@dataclass
class Node:
    """``any``: OR of the bitmaps below; ``all``: AND of them; sizes, members and their group (-1: several)."""

    any: np.ndarray
    all: np.ndarray
    low: int
    high: int
    members: np.ndarray
    group: int
    children: list["Node"]


def build(bits: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> Node:
    """Tree over the members, ordered by group, size and bitmap so that similar ones stand together."""
    keys = tuple(bits[:, k] for k in range(min(4, bits.shape[1]) - 1, -1, -1))
    order = np.lexsort((*keys, sizes, groups))
    level = [Node(bits[i], bits[i], int(sizes[i]), int(sizes[i]), np.array([i]), int(groups[i]), []) for i in order]
    while len(level) > 1:
        level = [_joined(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0]


def _joined(nodes: list[Node]) -> Node:
    if len(nodes) == 1:
        return nodes[0]
    return Node(
        np.bitwise_or.reduce([n.any for n in nodes]),
        np.bitwise_and.reduce([n.all for n in nodes]),
        min(n.low for n in nodes),
        max(n.high for n in nodes),
        np.concatenate([n.members for n in nodes]),
        nodes[0].group if all(n.group == nodes[0].group for n in nodes) else -1,
        nodes,
    )


def may_link(a: Node, b: Node, doubt: float = 1.0) -> bool:
    """Whether members of two nodes can be similar: sizes within four fifths, and the largest possible overlap.

    Every member of ``a`` has the bits of ``a.all``; those that no member of ``b`` has stand for
    shingles outside.  So an overlap is at most the larger size less those bits, from either side.
    With a ``doubt`` above 1 as many more bits count as outside, which leaves the likely pairs only.
    """
    if 100 * min(a.high, b.high) < 80 * max(a.low, b.low):
        return False
    # Sizes x, y with overlap at most x - out_a: the rule 180 * overlap >= 80 * (x + y) is easiest for large x, small y.
    out_a = doubt * int(np.bitwise_count(a.all & ~b.any).sum())
    if 180 * (a.high - out_a) < 80 * (a.high + b.low):
        return False
    out_b = doubt * int(np.bitwise_count(b.all & ~a.any).sum())
    return 180 * (b.high - out_b) >= 80 * (b.high + a.low)


class Joined:
    """Groups that have been put together, by their smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, group: int) -> int:
        while (up := self.parent.get(group, group)) != group:
            self.parent[group] = group = self.parent.get(up, up)
        return group

    def put(self, one: int, two: int) -> bool:
        """Whether the groups were apart until now."""
        one, two = self.find(one), self.find(two)
        self.parent[max(one, two)] = min(one, two)
        return one != two


def close_pairs(root_a: Node, root_b: Node, joined: Joined, doubt: float = 1.0) -> Iterator[tuple[int, int]]:
    """Member pairs of groups apart that the bounds leave, each once; ``joined`` may grow meanwhile."""
    stack = [(root_a, root_b)]
    while stack:
        a, b = stack.pop()
        if a.group != -1 != b.group and joined.find(a.group) == joined.find(b.group) or not may_link(a, b, doubt):
            continue
        if a is b:
            kids = a.children
            stack.extend((kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids)))
        elif not a.children and not b.children:
            yield int(a.members[0]), int(b.members[0])
        elif not b.children or a.children and len(a.members) >= len(b.members):
            stack.extend((kid, b) for kid in a.children)
        else:
            stack.extend((a, kid) for kid in b.children)


def _meetings(bitmaps: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Node, Node]]:
    """Trees that have to meet, and whose members stand in them: one tree per side and bitmap length.

    Similar sets differ by at most one step of length, so trees of neighbouring lengths meet at the
    shorter one.  With one side all pairs are wanted, with two sides only those across.
    """
    lengths = np.array([len(b) for b in bitmaps])

    def tree(at: np.ndarray, length: int) -> Node | None:
        return build(np.array([folded(bitmaps[i], length) for i in at]), sizes[at], groups[at]) if len(at) else None

    both = len(set(sides.tolist())) > 1
    for length in np.unique(lengths):
        left = np.flatnonzero((lengths == length) & (sides == 0 if both else True))
        right = np.flatnonzero((lengths == length) & (sides == 1)) if both else left
        meetings = [(left, right)]
        for n in (0, 1) if both else (None,):
            longer = np.flatnonzero((lengths == 2 * length) & (sides != n if both else True))
            meetings.append((np.flatnonzero((lengths == length) & (sides == n if both else True)), longer))
        for one, two in meetings:
            a = tree(one, length)
            b = a if two is one else tree(two, length)
            if a is not None and b is not None:
                yield one, two, a, b


def block_pairs(bitmaps: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray, sides: np.ndarray) -> Iterator[tuple[int, int]]:
    """All close pairs of a block."""
    for one, two, a, b in _meetings(bitmaps, sizes, groups, sides):
        yield from ((int(one[i]), int(two[j])) for i, j in close_pairs(a, b, Joined()))


def spanning_pairs(bitmaps: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray, sides: np.ndarray) -> Iterator[tuple[int, int]]:
    """Close pairs of a block that put its groups together, fewer than it has groups: likely pairs first, then any other."""
    joined, meetings = Joined(), list(_meetings(bitmaps, sizes, groups, sides))
    for doubt in (LIKELY, 1.0):
        for one, two, a, b in meetings:
            for i, j in close_pairs(a, b, joined, doubt):
                x, y = int(one[i]), int(two[j])
                if joined.put(int(groups[x]), int(groups[y])):
                    yield x, y
