"""Full matches of productions in time linear in the text.

An expression becomes an automaton by Thompson's construction; its states are built and sets of them found as texts need
them, and remembered (lazy determinisation). Unlike a backtracking matcher it has no text that takes it long, so no limit of time
is needed and results are the same on every machine. Possessive and atomic groups count as plain ones; a look ahead at one
character guards the step that follows it, a look behind the one before.
"""

from __future__ import annotations

try:
    from re import _constants as _c, _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p

#: Remembered sets of one automaton; beyond that they are forgotten and found again.
MEMORY = 20_000
END = ""


def _accepts(av):
    """A set of characters as a test; (False, set) of members or (True, set, ranges)."""
    neg, single, ranges = False, set(), []
    for op, a in av:
        if op is _c.NEGATE:
            neg = True
        elif op is _c.LITERAL:
            single.add(chr(a))
        elif op is _c.RANGE:
            ranges.append((chr(a[0]), chr(a[1])))
        else:
            raise ValueError(f"{op} in a set")
    return lambda x: x != END and (x in single or any(a <= x <= b for a, b in ranges)) != neg


class Automaton:
    """full(text): whether the expression matches the whole text."""

    def __init__(self, source: str):
        self.moves: list[list] = []  # state → [(test, target)]
        self.skips: list[list] = []  # state → [(guard or None, target)]
        self.unbuilt: dict[int, tuple] = {}  # state → node that stands between it and a target
        self.start, self.final = self._sequence(_p.parse(source))
        self._forget()

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _sequence(self, items) -> tuple[int, int]:
        a = at = self._state()
        for op, av in items:
            s, e = self._node(op, av) if op in (_c.LITERAL, _c.IN) else self._later(op, av)
            self.skips[at].append((None, s))
            at = e
        return a, at

    def _step(self, test) -> tuple[int, int]:
        a, b = self._state(), self._state()
        self.moves[a].append((test, b))
        return a, b

    def _later(self, op, av) -> tuple[int, int]:
        a, b = self._state(), self._state()
        self.unbuilt[a] = op, av, b
        return a, b

    def _build(self, at: int) -> None:
        op, av, b = self.unbuilt.pop(at)
        s, e = self._node(op, av)
        self.skips[at].append((None, s))
        self.skips[e].append((None, b))

    def _node(self, op, av) -> tuple[int, int]:
        if op is _c.LITERAL:
            return self._step(lambda x, c=chr(av): x == c)
        if op is _c.NOT_LITERAL:
            return self._step(lambda x, c=chr(av): x != c and x != END)
        if op is _c.ANY:
            return self._step(lambda x: x != END and x != "\n")
        if op is _c.IN:
            return self._step(_accepts(av))
        if op is _c.SUBPATTERN:
            return self._sequence(av[3])
        if op is getattr(_c, "ATOMIC_GROUP", None):
            return self._sequence(av)
        if op is _c.BRANCH:
            a, b = self._state(), self._state()
            for x in av[1]:
                s, e = self._sequence(x)
                self.skips[a].append((None, s))
                self.skips[e].append((None, b))
            return a, b
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT, getattr(_c, "POSSESSIVE_REPEAT", None)):
            lo, hi, sub = av
            a = at = self._state()
            for _ in range(lo):
                s, e = self._sequence(sub)
                self.skips[at].append((None, s))
                at = e
            if hi is _c.MAXREPEAT:
                s, e = self._sequence(sub)
                b = self._state()
                self.skips[at] += [(None, s), (None, b)]
                self.skips[e] += [(None, s), (None, b)]
                return a, b
            b = self._state()
            for _ in range(hi - lo):
                s, e = self._sequence(sub)
                self.skips[at] += [(None, s), (None, b)]
                at = e
            self.skips[at].append((None, b))
            return a, b
        a, b = self._state(), self._state()
        if op is _c.AT and av in (_c.AT_END_STRING, _c.AT_END):
            guard = ("next", lambda x: x == END)
        elif op is _c.AT and av in (_c.AT_BEGINNING_STRING, _c.AT_BEGINNING):
            guard = ("last", lambda x: x == END)
        elif op in (_c.ASSERT, _c.ASSERT_NOT) and len(av[1]) == 1:
            (o, v), where = av[1][0], "next" if av[0] > 0 else "last"
            one = {_c.LITERAL: lambda x: x == chr(v), _c.ANY: lambda x: x != END}.get(o) or _accepts(v)
            guard = (where, one if op is _c.ASSERT else lambda x: not one(x))
        else:
            raise ValueError(f"{op} {av}")
        self.skips[a].append((guard, b))
        return a, b

    def _forget(self) -> None:
        self.sets: list[list[int]] = [[self.start]]
        self.number: dict[tuple, int] = {(self.start,): 0}
        self.steps: list[dict] = [{}]

    def _closed(self, states, last: str, nxt: str) -> set[int]:
        """What the states reach without a step between the characters last and nxt."""
        seen, todo, skips, unbuilt = set(states), list(states), self.skips, self.unbuilt
        while todo:
            at = todo.pop()
            if at in unbuilt:
                self._build(at)
            for guard, to in skips[at]:
                if to not in seen and (guard is None or guard[1](nxt if guard[0] == "next" else last)):
                    seen.add(to)
                    todo.append(to)
        return seen

    def _next(self, at: int, last: str, x: str) -> int:
        """The number of the set that x leads to, -1 where it is empty."""
        moves = self.moves
        key = tuple(sorted({to for s in self._closed(self.sets[at], last, x) for test, to in moves[s] if test(x)}))
        if not key:
            out = -1
        else:
            out = self.number.get(key)
            if out is None:
                out = self.number[key] = len(self.sets)
                self.sets.append(list(key))
                self.steps.append({})
        self.steps[at][last, x] = out
        return out

    def full(self, text: str) -> bool:
        if len(self.sets) > MEMORY:
            self._forget()
        at, last, steps = 0, END, self.steps
        for x in text:
            to = steps[at].get((last, x))
            if to is None:
                to = self._next(at, last, x)
            if to < 0:
                return False
            at, last = to, x
        ok = steps[at].get((last, END))
        if ok is None:
            ok = steps[at][last, END] = self.final in self._closed(self.sets[at], last, END)
        return ok
