"""Generalised LR repair of a sequence of roles at least cost.

The tables are built from the grammar below (SLR, reductions by look-ahead). A parse is a stack of
table states; stacks share their lower parts. All cheap stacks advance together over the rows: a row
is kept, given another role or deleted, and roles are inserted before it; stacks with equal tops are
merged into the one of least (cost, audit). In this grammar a top determines the whole stack below it,
so no merge loses a parse.
"""

from __future__ import annotations

from functools import cached_property

#: ``(s? (ua)+)?`` over the initials of system, user and assistant.
GRAMMAR = (("goal", ("talk",)), ("talk", ()), ("talk", ("body",)), ("body", ("s", "u", "a")), ("body", ("u", "a")), ("body", ("body", "u", "a")))
ROLES = {"u": "user", "a": "assistant"}
END = "$"
REROLE, DELETE, INSERT, TRUNCATED_KEPT = 1, 2, 5, 5
#: A row is a letter: its initial (s, u, a, other) times four plus its fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"


def code(initial: int, fault: int) -> str:
    return chr(97 + 4 * initial + fault)


class Table:
    """SLR states of a grammar: closures of items, gotos and look-aheads of reductions."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = grammar
        self.names = {left for left, _ in grammar}
        self.states, self.go = [], {}
        self._number(self._closure({(0, 0)}))
        for at in range(10**6):
            if at == len(self.states):
                break
            for symbol in {self._next(i) for i in self.states[at]} - {None}:
                moved = {(rule, dot + 1) for rule, dot in self.states[at] if self._next((rule, dot)) == symbol}
                self.go[at, symbol] = self._number(self._closure(moved))

    def _next(self, item):
        rule, dot = item
        right = self.grammar[rule][1]
        return right[dot] if dot < len(right) else None

    def _closure(self, items):
        items, size = set(items), -1
        while len(items) != size:
            size = len(items)
            wanted = {self._next(i) for i in items}
            items |= {(r, 0) for r, (left, _) in enumerate(self.grammar) if left in wanted}
        return frozenset(items)

    def _number(self, items):
        if items not in self.states:
            self.states.append(items)
        return self.states.index(items)

    @cached_property
    def follow(self) -> dict[str, set[str]]:
        first = {n: set() for n in self.names}
        empty = {left for left, right in self.grammar if not right}
        after = {n: set() for n in self.names} | {self.grammar[0][0]: {END}}
        for _ in range(len(self.grammar) * len(self.names)):
            for left, right in self.grammar:
                if right and all(s in empty for s in right):
                    empty.add(left)
                for i, s in enumerate(right):
                    if all(x in empty for x in right[:i]):
                        first[left] |= first.get(s, {s})
                    if s in self.names:
                        rest = right[i + 1 :]
                        for j, x in enumerate(rest):
                            if all(y in empty for y in rest[:j]):
                                after[s] |= first.get(x, {x})
                        if all(x in empty for x in rest):
                            after[s] |= after[left]
        return after

    def reduced(self, stack, look):
        """The stack and all that reductions before ``look`` make of it."""
        out, todo = [], [stack]
        while todo:
            top = todo.pop()
            out.append(top)
            for rule, dot in self.states[top[0]]:
                left, right = self.grammar[rule]
                if rule and dot == len(right) and look in self.follow[left]:
                    base = top
                    for _ in right:
                        base = base[1]
                    todo.append((self.go[base[0], left], base))
        return out

    def shifted(self, stack, token):
        return [(self.go[s[0], token], s) for s in self.reduced(stack, token) if (s[0], token) in self.go]

    def accepts(self, stack) -> bool:
        return any((0, 1) in self.states[s[0]] for s in self.reduced(stack, END))


class Repairer:
    """Cheapest edits of a coded sequence, one letter per row and inserted role.

    A frontier is the stacks alive after a row, by top, in the order of their audits, with costs less
    the least one. No audit of a frontier starts another one (each ends with a row's letter), so the
    order of two parents decides, and audits need not be compared as strings. From the cheapest stack
    at most three inserts reach whatever another one could reach; dearer stacks are dropped. Frontiers
    are therefore finitely many, and a step is looked up after its first use.
    """

    SLACK = 3 * INSERT

    def __init__(self):
        self.table = Table()
        start = (0, None)
        self.stacks = {0: start}
        self.fronts, self.numbers = [((0, 0),)], {((0, 0),): 0}
        self.moves: list[dict] = [{}]
        self.ends: dict[int, tuple] = {}

    def _with_inserts(self, stack):
        """(stack, inserts) for each top that inserted roles lead to, fewest first."""
        out, seen, level = [], set(), [stack]
        inserts = 0
        while level:
            level = [s for s in dict.fromkeys(level) if s[0] not in seen]
            seen |= {s[0] for s in level}
            out += [(s, inserts) for s in level]
            level = [n for s in level for token in ROLES for n in self.table.shifted(s, token)]
            inserts += 1
        return out

    def _step(self, front, letter):
        initial, fault = divmod(ord(letter) - 97, 4)
        own = INITIALS[initial] if initial < len(INITIALS) else None
        best: dict[int, tuple] = {}

        def offer(stack, cost, rank, letters):
            offered = (cost, rank, letters)
            if stack[0] not in best or offered < best[stack[0]]:
                best[stack[0]] = offered
            self.stacks.setdefault(stack[0], stack)

        for rank, (top, cost) in enumerate(front):
            for stack, inserts in self._with_inserts(self.stacks[top]):
                so_far, before = cost + INSERT * inserts, "I" * inserts
                offer(stack, so_far + DELETE, rank, before + "D")
                if fault in (BLANK, DUPLICATE):
                    continue
                kept = so_far + (TRUNCATED_KEPT if fault == TRUNCATED else 0)
                for token in {own, *ROLES} - {None}:
                    same = token == own
                    for new in self.table.shifted(stack, token):
                        offer(new, kept + (0 if same else REROLE), rank, before + ("K" if same else "R"))
        least = min(cost for cost, _, _ in best.values())
        alive = sorted((rank, letters, top, cost - least) for top, (cost, rank, letters) in best.items() if cost - least <= self.SLACK)
        new = tuple((top, cost) for _, _, top, cost in alive)
        if new not in self.numbers:
            self.numbers[new] = len(self.fronts)
            self.fronts.append(new)
            self.moves.append({})
        return self.numbers[new], least, tuple((rank, letters) for rank, letters, _, _ in alive)

    def _end(self, front):
        return min(
            (cost + INSERT * inserts, rank, "I" * inserts)
            for rank, (top, cost) in enumerate(front)
            for stack, inserts in self._with_inserts(self.stacks[top])
            if self.table.accepts(stack)
        )

    def repair(self, codes: str) -> tuple[int, str]:
        """(cost, audit) of a conversation given as a letter per row."""
        at, total, back = 0, 0, []
        for letter in codes:
            move = self.moves[at].get(letter)
            if move is None:
                move = self.moves[at][letter] = self._step(self.fronts[at], letter)
            at = move[0]
            total += move[1]
            back.append(move[2])
        if at not in self.ends:
            self.ends[at] = self._end(self.fronts[at])
        cost, rank, last = self.ends[at]
        letters = [last]
        for step in reversed(back):
            rank, part = step[rank]
            letters.append(part)
        return total + cost, "".join(reversed(letters))


def faults(codes: str) -> tuple[int, int, int, int]:
    """How many rows are blank, duplicate, truncated, and how many neighbours no grammar allows."""
    numbers = [ord(c) - 97 for c in codes]
    kinds = [n % 4 for n in numbers]
    roles = [n // 4 for n in numbers]
    good = {(0, 1), (1, 2), (2, 1)}
    illegal = sum(pair not in good for pair in zip(roles, roles[1:]))
    return kinds.count(BLANK), kinds.count(DUPLICATE), kinds.count(TRUNCATED), illegal


class Line:
    """Follows an audit over rows and gives the lines of the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _due(self) -> str:
        return "a" if self.last == "u" else "u"

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.last = self._due()
            self.at += 1
            yield ROLES[self.last] + ":"

    def row(self, role: str, text: str):
        """The lines up to and with this row; none for it if it is deleted."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.last = role[:1]
            yield f"{role}:{text}"
        elif edit == "R":
            self.last = self._due()
            yield f"{ROLES[self.last]}:{text}"
