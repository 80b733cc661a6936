"""Regular expressions to one minimal automaton over bytes.

Patterns may use literals, escapes, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m}`` and
``{m,}``; ASCII only. ``compile_rules`` builds a nondeterministic automaton for all rules,
makes it deterministic by subset construction, merges equal states (partition refinement)
and numbers states so that those at which a rule ends come last.
"""

from __future__ import annotations

from dataclasses import dataclass

ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass
class Automaton:
    """rows[state][byte] is the next state, ends[state] the rules that end there (a bit each)."""

    rows: list[list[int]]
    ends: list[int]
    first_end: int
    start: int


class _Net:
    """Fragments with one entry and one exit; edges on a set of bytes, and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def build(self, tree, backwards: bool) -> tuple[int, int]:
        kind, a, b = tree[0], self.state(), self.state()
        if kind == "set":
            self.edges[a].append((tree[1], b))
        elif kind == "seq":
            at = a
            for part in reversed(tree[1]) if backwards else tree[1]:
                x, y = self.build(part, backwards)
                self.empty[at].append(x)
                at = y
            self.empty[at].append(b)
        elif kind == "alt":
            for part in tree[1]:
                x, y = self.build(part, backwards)
                self.empty[a].append(x)
                self.empty[y].append(b)
        else:  # repeat: tree[1], least, most (None: no bound)
            part, least, most = tree[1:]
            at = a
            for i in range(max(least, most or 0)):
                x, y = self.build(part, backwards)
                self.empty[at].append(x)
                if i >= least:
                    self.empty[at].append(b)
                at = y
            if most is None:
                x, y = self.build(part, backwards)
                self.empty[at] += [x, b]
                self.empty[y] += [x, b]
            self.empty[at].append(b)
        return a, b

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def parse(pattern: str, ignore_case: bool = False):
    """The pattern's tree: ("set", bytes), ("seq", parts), ("alt", parts), ("repeat", part, least, most)."""
    at = 0

    def fold(chars):
        out = set(chars)
        if ignore_case:
            out |= {c.lower() for c in chars} | {c.upper() for c in chars}
        return frozenset(map(ord, out))

    def escaped():
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return chr(int(pattern[at - 2:at], 16))
        return ESCAPES.get(c, c)

    def one():
        nonlocal at
        c = pattern[at]
        at += 1
        return escaped() if c == "\\" else c

    def chars():
        nonlocal at
        out, negated = set(), pattern[at] == "^"
        at += negated
        while pattern[at] != "]":
            low = high = one()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = one()
            out |= {chr(i) for i in range(ord(low), ord(high) + 1)}
        at += 1
        return ("set", frozenset(range(256)) - fold(out) if negated else fold(out))

    def choice():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            if pattern[at] == "(":
                at += 1
                part = choice()
                at += 1
            elif pattern[at] == "[":
                at += 1
                part = chars()
            else:
                part = ("set", fold(one()))
            while at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                at += 1
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
                if c == "{":
                    end = pattern.index("}", at)
                    low, _, high = pattern[at:end].partition(",")
                    least, most = int(low), (None if pattern[at:end].endswith(",") else int(high or low))
                    at = end + 1
                part = ("repeat", part, least, most)
            parts.append(part)
        return ("seq", parts)

    return choice()


def compile_rules(trees: list, search: bool, backwards: bool = False) -> Automaton:
    """One automaton for all trees. ``search``: a match may begin anywhere."""
    net = _Net()
    ends: dict[int, int] = {}
    starts = []
    for i, tree in enumerate(trees):
        a, b = net.build(tree, backwards)
        starts.append(a)
        ends[b] = ends.get(b, 0) | 1 << i
    begin = net.closure(starts)

    # Bytes that no edge tells apart share a column.
    used = {s for edges in net.edges for s, _ in edges}
    groups: dict[tuple, list[int]] = {}
    for byte in range(256):
        groups.setdefault(tuple(byte in s for s in used), []).append(byte)
    kinds = list(groups.values())

    numbers, order, table = {begin: 0}, [begin], []
    for states in order:
        row = []
        for kind in kinds:
            after = {t for s in states for on, t in net.edges[s] if kind[0] in on}
            after = net.closure(after | set(begin)) if search else net.closure(after)
            if after not in numbers:
                numbers[after] = len(order)
                order.append(after)
            row.append(numbers[after])
        table.append(row)
    found = []
    for states in order:
        mask = 0
        for s in states:
            mask |= ends.get(s, 0)
        found.append(mask)

    block = [found[i] for i in range(len(order))]
    blocks = len(set(block))
    while True:
        names: dict[tuple, int] = {}
        block = [names.setdefault((block[i], *(block[t] for t in table[i])), len(names)) for i in range(len(order))]
        if len(names) == blocks:
            break
        blocks = len(names)
    first = {}
    for i, b in enumerate(block):
        first.setdefault(b, i)
    ranked = sorted(first, key=lambda b: (found[first[b]] != 0, b))
    place = {b: k for k, b in enumerate(ranked)}
    rows = []
    for b in ranked:
        row = [0] * 256
        for kind, t in zip(kinds, table[first[b]]):
            for byte in kind:
                row[byte] = place[block[t]]
        rows.append(row)
    masks = [found[first[b]] for b in ranked]
    return Automaton(rows, masks, sum(m == 0 for m in masks), place[block[0]])
