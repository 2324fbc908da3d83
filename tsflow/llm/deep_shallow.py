"""Deep-shallow sorting of byte strings (Manzini and Ferragina), for strings with long common prefixes.

Multikey quicksort, eight bytes at a step, orders the strings to a shallow depth.  Groups that
still agree there are put in order by a blind trie: it stores only branching depths and bytes,
a string is first searched blindly, and one comparison with the leaf found gives its place.
"""

from __future__ import annotations

SHALLOW = 16   # bytes
STEP = 8       # bytes compared at once by the quicksort
END = -1       # a string that ends sorts before those that go on


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree before ``at``."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x, y = a[at:n], b[at:n]
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return at + len(x) - (differ.bit_length() + 7) // 8


def blind_order(strings: list[bytes], group: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Order of a group that agrees to ``depth``, and the common prefix of each with the one before."""
    # a node is [branch depth, {byte: child}, a string below it]; a leaf is a list of equal strings
    root = None
    for i in group:
        s = strings[i]
        if root is None:
            root = [i]
            continue
        node = root
        while isinstance(node, tuple):  # blind: bytes between branches are skipped
            at, children, any_leaf = node
            node = children.get(s[at] if at < len(s) else END, any_leaf)
        other = strings[node[0]]
        lcp = common(s, other, depth)
        if lcp == len(s) == len(other):
            node.append(i)
            continue
        mine, theirs = s[lcp] if lcp < len(s) else END, other[lcp] if lcp < len(other) else END
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < lcp:
            parent, key = node, s[node[0]]
            node = node[1][key]
        leaf = [i]
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][mine] = leaf
            continue
        split = (lcp, {theirs: node, mine: leaf}, node if isinstance(node, list) else node[2])
        if parent is None:
            root = split
        else:
            parent[1][key] = split
    order, lcps, stack = [], [], [(root, 0)]
    while stack:
        node, lcp = stack.pop()
        if isinstance(node, tuple):
            keys = sorted(node[1], reverse=True)
            stack += [(node[1][k], node[0]) for k in keys[:-1]] + [(node[1][keys[-1]], lcp)]
        else:
            order += node
            lcps += [lcp] + [len(strings[node[0]])] * (len(node) - 1)
    return order, lcps


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Indices in sorted order, and for each the length of its common prefix with the one before
    (0 for the first)."""
    order: list[int] = []
    lcps: list[int] = []
    stack = [(list(range(len(strings))), 0, 0)] if strings else []  # group, depth to which it agrees, common prefix with the group before
    while stack:
        group, depth, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            lcps.append(before)
        elif depth >= SHALLOW:
            o, ls = blind_order(strings, group, depth)
            ls[0] = before
            order += o
            lcps += ls
        else:
            pivot = strings[group[len(group) // 2]][depth:depth + STEP]
            less, same, more = [], [], []
            for i in group:
                key = strings[i][depth:depth + STEP]
                (same if key == pivot else less if key < pivot else more).append(i)
            parts = [(g, depth + STEP if g is same and len(pivot) == STEP else depth, g is same and len(pivot) < STEP)
                     for g in (less, same, more) if g]
            for k in range(len(parts) - 1, -1, -1):
                g, d, ended = parts[k]
                # a part's first string is the least of it: its prefix with the part before is settled below
                stack.append((g, SHALLOW if ended else d, before if k == 0 else -1))
    for k in range(1, len(order)):
        if lcps[k] < 0:  # neighbours from two parts: they differ within the shallow depth
            lcps[k] = common(strings[order[k - 1]], strings[order[k]], 0)
    if lcps:
        lcps[0] = 0
    return order, lcps
