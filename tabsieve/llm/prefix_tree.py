"""A radix tree of ordered integer sequences, and the overlap join that walks it."""

from __future__ import annotations

import numpy as np


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


class Node:
    __slots__ = ("kids", "label", "leaves", "most", "least", "depth", "one")

    def __init__(self, label: np.ndarray, depth: int):
        self.label, self.depth = label, depth  # depth: tokens from the root to the end of the label
        self.kids: list[Node] = []
        self.leaves: list[int] = []
        self.one = -1  # a leaf below, if all leaves below are known to be of one class


def build(sequences: list[np.ndarray], members: list[int]) -> Node:
    """The tree of ascending integer sequences; members are their numbers."""
    order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes())
    root = Node(np.empty(0, np.int64), 0)
    path = [root]
    last = np.empty(0, np.int64)
    for i in order:
        s = sequences[i]
        k = min(len(s), len(last))
        diff = np.flatnonzero(s[:k] != last[:k])
        shared = int(diff[0]) if len(diff) else k
        while path[-1].depth > shared and len(path) > 1 and path[-2].depth >= shared:
            path.pop()
        top = path[-1]
        if top.depth > shared:  # split the label
            keep = len(top.label) - (top.depth - shared)
            low = Node(top.label[keep:], top.depth)
            low.kids, low.leaves = top.kids, top.leaves
            top.label, top.depth, top.kids, top.leaves = top.label[:keep], shared, [low], []
        if len(s) > shared:
            leaf = Node(s[shared:], len(s))
            path[-1].kids.append(leaf)
            path.append(leaf)
        path[-1].leaves.append(members[i])
        last = s
    return root


def _down(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += n.kids
    return out


def _sizes(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        n.most = max([n.depth] * bool(n.leaves) + [k.most for k in n.kids])
        n.least = min([n.depth] * bool(n.leaves) + [k.least for k in n.kids])


def _classes(nodes: list[Node], union: Union) -> None:
    for n in reversed(nodes):
        found = {union.find(x) for x in n.leaves}
        n.one = -1
        if any(k.one < 0 for k in n.kids):
            continue
        found |= {union.find(k.one) for k in n.kids}
        if len(found) == 1:
            n.one = found.pop()


def link(sequences: list[np.ndarray], queries: range, targets: range, percent: int = 80) -> Union:
    """Classes of sets linked by 100 * intersection >= percent * union, directly or through others.

    sequences are sets of small integers in ascending global order.  Each query walks the tree of the targets from
    the root: the overlap of a shared prefix is counted once for all sets below it, and a subtree is left as soon
    as the tokens that remain on either side cannot bring any set in it to the threshold, or when all of it is
    already in the query's class.
    """
    union = Union(len(sequences))
    if not len(queries) or not len(targets):
        return union
    root = build([sequences[i] for i in targets], list(targets))
    nodes = _down(root)
    _sizes(nodes)
    top = max((int(s[-1]) for s in sequences if len(s)), default=0) + 1
    held = np.zeros(top, dtype=np.int64)
    joined, due = 0, 1
    for q in queries:
        s = sequences[q]
        a = len(s)
        held[s] = 1
        stack = [(root, 0)]
        own = union.find(q)
        while stack:
            node, have = stack.pop()
            if node.one >= 0 and union.find(node.one) == own:
                continue
            if len(node.label):
                have += int(held[node.label].sum())
                rest = a - int(np.searchsorted(s, node.label[-1], side="right"))
            else:
                rest = a
            size = min(max(node.depth + rest, node.least), node.most)
            if 100 * (have + min(size - node.depth, rest)) < percent * (a + size - (have + min(size - node.depth, rest))):
                continue
            if node.leaves and 100 * have >= percent * (a + node.depth - have):
                for x in node.leaves:
                    if x != q and union.join(x, q):
                        joined += 1
                own = union.find(q)
            stack += [(k, have) for k in node.kids]
        held[s] = 0
        if joined >= due:
            _classes(nodes, union)
            due = joined + max(1, len(nodes) // 16)
    return union
