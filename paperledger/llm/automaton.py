"""Regular expressions to one deterministic automaton over bytes: positions by Thompson's construction, states by
subset construction, merged by partition refinement.

Syntax: literals, ``\\xHH`` and escaped signs, classes with ranges and ``^``, groups, ``|``, ``?``, ``*``, ``+``,
``{m}``, ``{m,}`` and ``{m,n}``. Matches are of bytes; there are no captures and no anchors. An automaton has
``MOST_STATES`` states at most; rules that need more together are compiled into several (``several``), and only a single
rule that needs more alone is refused.
"""

from __future__ import annotations

from collections import defaultdict

MOST_STATES = 50_000


class _Nfa:
    def __init__(self):
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1


class _Parser:
    """Trees: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most or None)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def whole(self):
        tree = self.either()
        if self.at < len(self.text):
            raise ValueError(f"{self.text!r}: unexpected {self.peek()!r} at {self.at}")
        return tree

    def either(self):
        parts = [self.row()]
        while self.peek() == "|":
            self.take()
            parts.append(self.row())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def row(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            part = self.one()
            while self.peek() and self.peek() in "?*+{":
                part = ("rep", part, *self.times())
            parts.append(part)
        return ("cat", parts)

    def times(self) -> tuple[int, int | None]:
        sign = self.take()
        if sign != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
        body = self.text[self.at : self.text.index("}", self.at)]
        self.at += len(body) + 1
        low, comma, high = body.partition(",")
        return int(low), (int(high) if high else None) if comma else int(low)

    def sign(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "r": "\r", "t": "\t"}.get(c, c))

    def one(self):
        if self.peek() == "(":
            self.take()
            tree = self.either()
            if self.take() != ")":
                raise ValueError(f"{self.text!r}: a group is open")
            return tree
        if self.peek() != "[":
            return ("set", frozenset([self.sign()]))
        self.take()
        inverse = self.peek() == "^"
        self.at += inverse
        found: set[int] = set()
        while self.peek() != "]":
            low = self.sign()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                found.update(range(low, self.sign() + 1))
            else:
                found.add(low)
        self.take()
        return ("set", frozenset(range(256)) - found if inverse else frozenset(found))


def _build(nfa: _Nfa, tree, start: int) -> int:
    """Add ``tree`` from ``start`` on; its end state."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.steps[start].append((tree[1], end))
        return end
    if kind == "cat":
        for part in tree[1]:
            start = _build(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.state()
        for part in tree[1]:
            begin = nfa.state()
            nfa.free[start].append(begin)
            nfa.free[_build(nfa, part, begin)].append(end)
        return end
    _, part, least, most = tree
    for _ in range(least):
        start = _build(nfa, part, start)
    if most is None:
        loop = nfa.state()
        nfa.free[start].append(loop)
        nfa.free[_build(nfa, part, loop)].append(loop)
        return loop
    end = nfa.state()
    for _ in range(most - least):
        nfa.free[start].append(end)
        start = _build(nfa, part, start)
    nfa.free[start].append(end)
    return end


def _turned(tree):
    """The tree of the words read backward."""
    if tree[0] == "cat":
        return ("cat", [_turned(t) for t in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [_turned(t) for t in tree[1]])
    if tree[0] == "rep":
        return ("rep", _turned(tree[1]), *tree[2:])
    return tree


class TooLarge(ValueError):
    """The rules need more states than an automaton may have."""


class Automaton:
    """``classes``: a translation table of bytes to ``width`` classes; ``next``: the transition array, whose states are
    numbered in steps of ``width``; states from ``accepting`` on accept; ``rules[state]``: a bit for each pattern;
    ``dead``: the state that nothing leaves, or -1."""

    def __init__(self, patterns: list[str], anywhere: bool, backward: bool = False):
        nfa = _Nfa()
        start = nfa.state()
        ends = {}
        for i, p in enumerate(patterns):
            begin = nfa.state()
            nfa.free[start].append(begin)
            tree = _Parser(p).whole()
            ends[_build(nfa, _turned(tree) if backward else tree, begin)] = 1 << i
        if anywhere:
            nfa.steps[start].append((frozenset(range(256)), start))
        self._number(*self._merge(*self._subsets(nfa, start, ends)))

    def _subsets(self, nfa: _Nfa, start: int, ends: dict[int, int]):
        kinds: dict[tuple, list[int]] = defaultdict(list)
        sets = sorted({s for steps in nfa.steps for s, _ in steps}, key=sorted)
        for b in range(256):
            kinds[tuple(b in s for s in sets)].append(b)
        groups = list(kinds.values())
        self.width = len(groups)
        self.classes = bytes(next(i for i, g in enumerate(groups) if b in g) for b in range(256))

        def reach(states: set[int]) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if nfa.steps[s] or s in ends)

        first = reach({start})
        number, rows, todo = {first: 0}, [], [first]
        for states in todo:
            row = []
            for g in groups:
                after = reach({t for s in states for on, t in nfa.steps[s] if g[0] in on})
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                    if len(number) > MOST_STATES:
                        raise TooLarge(f"over {MOST_STATES} states; give the rules shorter counts")
                row.append(number[after])
            rows.append(row)
        return rows, [sum({ends[s] for s in states if s in ends}) for states in todo], [not s for s in todo]

    def _merge(self, rows: list[list[int]], accepts: list[int], empty: list[bool]):
        """Moore's refinement: states stay together while all their next states do."""
        block = accepts
        count = 0
        while True:
            names: dict[tuple, int] = {}
            block = [names.setdefault((block[i], *(block[j] for j in row)), len(names)) for i, row in enumerate(rows)]
            if len(names) == count:
                break
            count = len(names)
        first = {b: i for i, b in reversed(list(enumerate(block)))}
        merged = [[block[j] for j in rows[first[b]]] for b in range(count)]
        return merged, [accepts[first[b]] for b in range(count)], [empty[first[b]] for b in range(count)], block[0]

    def _number(self, rows: list[list[int]], accepts: list[int], empty: list[bool], start: int) -> None:
        order = sorted(range(len(rows)), key=lambda s: (bool(accepts[s]), s != start))
        name = {s: i * self.width for i, s in enumerate(order)}
        self.next = [name[t] for s in order for t in rows[s]]
        self.rules = {name[s]: accepts[s] for s in order}
        self.accepting = min([name[s] for s in order if accepts[s]], default=len(self.next))
        self.start = name[start]
        self.dead = next((name[s] for s in order if empty[s]), -1)
        self.states = len(rows)

    def seen(self, data: bytes) -> int:
        """In one pass: a bit for each pattern that matches somewhere (automaton built with ``anywhere``)."""
        after, accepting, rules, s, found = self.next, self.accepting, self.rules, self.start, 0
        for c in data.translate(self.classes):
            s = after[s + c]
            if s >= accepting:
                found |= rules[s]
        return found

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """The end of the longest match from ``at``, or -1, and the number of bytes read (automaton built without
        ``anywhere``). ``data`` is translated already."""
        after, accepting, dead, s, end, i = self.next, self.accepting, self.dead, self.start, -1, at - 1
        for i in range(at, len(data)):
            s = after[s + data[i]]
            if s >= accepting:
                end = i + 1
            elif s == dead:
                break
        return end, i + 1 - at

    def starts(self, data: bytes) -> bytes:
        """For each byte, 1 where a match begins, in one pass from the end (automaton built ``anywhere`` and
        ``backward``). ``data`` is translated already."""
        after, accepting, s = self.next, self.accepting, self.start
        out = bytearray(len(data))
        for i in range(len(data) - 1, -1, -1):
            s = after[s + data[i]]
            if s >= accepting:
                out[i] = 1
        return bytes(out)


def several(patterns: list[str]) -> list[tuple[Automaton, int]]:
    """Automata that find the patterns anywhere, with the number of each one's first: one where their states allow it,
    else those of either half."""
    try:
        return [(Automaton(patterns, True), 0)]
    except TooLarge:
        if len(patterns) == 1:
            raise
    half = len(patterns) // 2
    return several(patterns[:half]) + [(a, first + half) for a, first in several(patterns[half:])]
