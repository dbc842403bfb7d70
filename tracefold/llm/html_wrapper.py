"""Union-free regular expressions over the element streams of a host's pages, inferred by iterative alignment.

A wrapper is a tree of nodes: elements (known by tag and name), texts
(``#text``) and groups. The children of an element are an ordered stream. A
page's own stream is first folded: siblings of one mark in a row, and rows of
two to four marks that repeat, become one repeated node or group. Two
streams are then aligned by their longest common subsequence; what matches is
merged further down, what doesn't becomes optional at its place. Texts that
differ between pages are slots, texts that stay the same are template.

All walks are iterative, so nesting may be as deep as a page makes it. Streams
of more than LONG_STREAMS pairs are aligned from left to right instead.
"""

from __future__ import annotations

import json

import xxhash

TEXT = "#text"
PERIODS = (2, 3, 4)
LONG_STREAMS = 10_000
#: From so many pages on, nodes of a single page leave a wrapper: the page knows them itself.
PRUNE_PAGES = 32


class Node:
    """mark, pages that have it, times in all of them, letters, least and greatest hash of a page's text, bits of page hashes, children in order."""

    __slots__ = ("bits", "high", "into", "kids", "letters", "low", "mark", "pages", "times")

    def __init__(self, mark: str, letters: int = 0, h: int = 0, kids: list | None = None):
        self.mark, self.pages, self.times, self.letters, self.low, self.high, self.bits = mark, 1, 1, letters, h, h, 0
        self.kids: list[Node] = kids or []
        self.into: Node | None = None

    def final(self) -> Node:
        """The node that this one was merged into."""
        node = self
        while node.into is not None:
            node = node.into
        at = self
        while at.into is not None and at.into is not node:
            at.into, at = node, at.into
        return node


def _absorb(a: Node, b: Node, same_page: bool) -> None:
    a.times += b.times
    a.letters += b.letters
    if same_page:
        a.low = a.high = xxhash.xxh64_intdigest(f"{a.low}:{b.low}") >> 1
    else:
        a.pages += b.pages
        a.low, a.high = min(a.low, b.low), max(a.high, b.high)
        a.bits |= b.bits
    b.into = a


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence (of the leftmost one, for very long streams)."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    pairs = [(i, i) for i in range(head)]
    if len(x) * len(y) <= LONG_STREAMS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                pairs.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[str, list[int]] = {}
        for i in range(len(x) - 1, -1, -1):
            places.setdefault(x[i], []).append(i)
        at = -1
        for j, mark in enumerate(y):
            left = places.get(mark, [])
            while left and left[-1] <= at:
                left.pop()
            if left:
                at = left.pop()
                pairs.append((head + at, head + j))
    return pairs + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


def _grouped(kids: list[Node], marks: list[str]) -> list[Node]:
    """The stream with each row of ``marks`` as one group; rows that follow each other are one repeated group."""
    out: list[Node] = []
    i, n = 0, len(marks)
    name = f"({' '.join(marks)})"
    while i < len(kids):
        if [k.mark for k in kids[i : i + n]] == marks:
            block = kids[i : i + n]
            group = Node(name, kids=block)
            group.pages, group.times, group.bits = max(k.pages for k in block), max(k.times for k in block), max((k.bits for k in block), key=int.bit_count)
            if out and out[-1].mark == name:
                merge(out[-1], group, True)
            else:
                out.append(group)
            i += n
        else:
            out.append(kids[i])
            i += 1
    return out


def fold(kids: list[Node]) -> list[Node]:
    """A page's stream of siblings with what repeats in a row as one node or group."""
    out: list[Node] = []
    for kid in kids:
        if out and out[-1].mark == kid.mark:
            merge(out[-1], kid, True)
        else:
            out.append(kid)
    for n in PERIODS:
        marks, i = [k.mark for k in out], 0
        while i + 2 * n <= len(marks):
            if marks[i : i + n] == marks[i + n : i + 2 * n] and not any(m.startswith("(") for m in marks[i : i + n]):
                out = _grouped(out, marks[i : i + n])
                marks, i = [k.mark for k in out], 0
                continue
            i += 1
    return out


def _level(a: list[Node], b: list[Node]) -> tuple[list[Node], list[Node]]:
    """Both streams with the groups that either has."""
    for one, other in ((a, b), (b, a)):
        names = {k.mark for k in other}
        for group in [k for k in one if k.mark.startswith("(") and k.mark not in names]:
            marks = [k.mark for k in group.kids]
            folded = _grouped(other, marks)
            if other is a:
                a = folded
            else:
                b = folded
            other = folded
    return a, b


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """``a`` generalised in place so that it also fits what ``b`` fits."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        _absorb(x, y, same_page)
        if not y.kids:
            continue
        if not x.kids:
            x.kids = y.kids
            continue
        left, right = _level(x.kids, y.kids)
        kids, i, j = [], 0, 0
        for p, q in [*matches([k.mark for k in left], [k.mark for k in right]), (len(left), len(right))]:
            kids += left[i:p] + right[j:q]
            if p < len(left):
                kids.append(left[p])
                todo.append((left[p], right[q]))
            i, j = p + 1, q + 1
        x.kids = kids
    return a


def ordered(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.kids)
    return out


def stream(tokens: list[tuple[int, str, str | None]]) -> list[tuple[int, str, int, int]]:
    """(parent's place, mark, text) of a page as ``of_page`` takes them."""
    return [(parent, mark, len(text or ""), xxhash.xxh64_intdigest(text or "") >> 1) for parent, mark, text in tokens]


def of_page(tokens: list[tuple[int, str, int, int]]) -> tuple[Node, list[Node]]:
    """The wrapper of one page alone and each token's node, from (parent's place, mark, letters, hash of the text) in page order."""
    nodes = [Node(mark, letters, h) for _, mark, letters, h in tokens]
    kids: list[list[Node]] = [[] for _ in tokens]
    for i in range(len(tokens) - 1, -1, -1):  # children before their parents
        kids[i].reverse()
        nodes[i].kids = fold(kids[i])
        if i:
            kids[tokens[i][0]].append(nodes[i])
    page = xxhash.xxh64_intdigest(",".join(str(h) for _, _, letters, h in tokens if letters)) % 61
    every = ordered(nodes[0])
    for node in every:
        node.bits = 1 << page
    return nodes[0], [n.final() for n in nodes]


def placed(own: Node, wrapper: Node | None) -> dict[Node, Node]:
    """The wrapper's node for each node of a page's own wrapper that has one."""
    if wrapper is None or own.mark != wrapper.mark:
        return {}
    out, todo = {}, [(own, wrapper)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        left, right = x.kids, y.kids
        groups = [k for k in right if k.mark.startswith("(")]
        if groups or any(k.mark.startswith("(") for k in left):
            # groups that only one side has are looked at through their members
            left_names, right_names = {k.mark for k in left}, {k.mark for k in right}
            left = [m for k in left for m in (k.kids if k.mark.startswith("(") and k.mark not in right_names else [k])]
            right = [m for k in right for m in (k.kids if k.mark.startswith("(") and k.mark not in left_names else [k])]
        todo += [(left[p], right[q]) for p, q in matches([k.mark for k in left], [k.mark for k in right])]
    return out


def pruned(root: Node) -> Node:
    if root.pages >= PRUNE_PAGES:
        for node in ordered(root):
            node.kids = [k for k in node.kids if k.pages > 1]
    return root


def written(root: Node) -> str:
    """A wrapper as JSON: rows [parent's place, mark, pages, times, letters, low, high, bits], parents first."""
    rows, place = [], {}
    todo = [(root, -1)]
    while todo:
        node, parent = todo.pop()
        place[node] = len(rows)
        rows.append([parent, node.mark, node.pages, node.times, node.letters, node.low, node.high, node.bits])
        todo += [(k, place[node]) for k in reversed(node.kids)]
    return json.dumps(rows, separators=(",", ":"), ensure_ascii=False)


def read(text: str) -> Node:
    nodes = []
    for parent, mark, pages, times, letters, low, high, bits in json.loads(text):
        node = Node(mark, letters, low)
        node.pages, node.times, node.high, node.bits = pages, times, high, bits
        nodes.append(node)
        if parent >= 0:
            nodes[parent].kids.append(node)
    return nodes[0]


def same_on(node: Node, pages: int) -> bool:
    """Whether all pages have one text here, and at least so many different pages do."""
    return node.low == node.high and node.bits.bit_count() >= pages


def expression(root: Node) -> str:
    """The wrapper as a regular expression: (...)? optional, (...)+ repeated, (...)* both; #slot for texts that differ, #text for those that stay."""
    out: dict[Node, str] = {}
    every = ordered(root)
    parent = {k: n for n in every for k in n.kids}
    for node in reversed(every):
        inner = "".join(out.pop(k) for k in node.kids)
        if node.mark == TEXT:
            body = "#text" if node.low == node.high else "#slot"
        else:
            body = f"({inner})" if node.mark.startswith("(") else f"<{node.mark}>{inner}</>"
        optional, repeated = node in parent and node.pages < parent[node].pages, node.times > node.pages * (parent[node].times / parent[node].pages if node in parent else 1)
        sign = "*" if optional and repeated else "+" if repeated else "?" if optional else ""
        out[node] = (body if body.startswith("(") and not body.startswith("(<(") else f"({body})") + sign if sign else body
    return out[root]
