"""Weighted finite-state machines over word classes: patterns, context rules, disguised words.

A word is read as one or more *readings* ``(classes, weight)``, classes being a bit set.  Three kinds of machine are
compiled once per process and composed while they run:

* ``Disguise`` composes a character transducer (digits and look-alikes for letters, masks, drawn-out letters, each at
  a cost) with the trie of a lexicon and gives the best reading of a token;
* ``Contexts`` is a bimachine: one automaton reads the clause from the left, one from the right, and where the left and
  the right context of a rule both hold, classes are taken off the word between them;
* ``Patterns`` is a weighted automaton in the (max, +) semiring.  Its best path through the readings of a clause is
  the clause's score: the weights of patterns that don't overlap add up.

Automata are made deterministic lazily: a state is a set of (state, residual weight) and each step, once taken, is a
dictionary entry, so a text costs one look-up per word however many patterns there are.

Pattern language: ``NAME`` a word of that class, ``word`` that very word, ``A!B`` of class A and not B, ``!A`` or ``.!A`` any
word not of class A, ``.`` any word; none of these but ``COMMA`` and ``~`` match a comma.  ``^`` and ``$`` are the ends of the
clause; ``( | )``, ``? * +`` and ``{m,n}`` as usual; ``x/0.3`` adds a weight; ``<M>`` stands for a named part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: Bits of the clause end and of the comma.
EDGE, COMMA = 1, 2
Reading = tuple[int, float]
_PART = re.compile(r"\s*([()|?*+^$]|\{\d+,\d+\}|[A-Z]*(?:![A-Z]+)+|[A-Z]+|[^\W\d_A-Z]+|[.~])(?:/(\d+(?:\.\d+)?))?")
#: States of a lazy automaton that are kept; beyond them it starts anew, which changes no result.
MOST_STATES = 100_000


class Classes:
    """Names of word classes and their bits; words that patterns name are classes of their own."""

    def __init__(self, names: Iterable[str]):
        self.bits = {name: 4 << i for i, name in enumerate(names)}
        self.words: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        if word not in self.words:
            self.words[word] = 4 << (len(self.bits) + len(self.words))
        return self.words[word]


# Patterns as trees: ("arc", need, forbid, weight), ("cat", [..]), ("or", [..]), ("rep", tree, least, most or None).
def parse(text: str, classes: Classes, macros: dict[str, str]) -> tuple:
    """The tree of a pattern."""
    for _ in range(8):
        text = re.sub(r"<([A-Z]+)>", lambda m: f"( {macros[m.group(1)]} )", text)
    text = text.replace(".!", "!")
    parts, at = [], 0
    while text[at:].strip():
        match = _PART.match(text, at)
        if match is None:
            raise ValueError(f"can't read {text[at:]!r}")
        parts.append((match.group(1), float(match.group(2) or 0)))
        at = match.end()
    place = 0

    def arc(name: str, weight: float) -> tuple:
        if name in ("^", "$"):
            return ("arc", EDGE, 0, weight)
        if name == "~":
            return ("arc", 0, EDGE, weight)
        if name == "COMMA":
            return ("arc", COMMA, EDGE, weight)
        if name == ".":
            return ("arc", 0, EDGE | COMMA, weight)
        if name.islower():
            return ("arc", classes.of_word(name), EDGE | COMMA, weight)
        need, *lacking = name.split("!")
        forbid = EDGE | COMMA
        for x in lacking:
            forbid |= classes.bits[x]
        return ("arc", classes.bits[need] if need else 0, forbid, weight)

    def choice() -> tuple:
        nonlocal place
        options = [sequence()]
        while place < len(parts) and parts[place][0] == "|":
            place += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence() -> tuple:
        nonlocal place
        items: list[tuple] = []
        while place < len(parts) and parts[place][0] not in "|)":
            name, weight = parts[place]
            place += 1
            if name == "(":
                items.append(choice())
                place += 1
            elif name in "?*+":
                items[-1] = ("rep", items[-1], 1 if name == "+" else 0, 1 if name == "?" else None)
            elif name[0] == "{":
                least, most = map(int, name[1:-1].split(","))
                items[-1] = ("rep", items[-1], least, most)
            else:
                items.append(arc(name, weight))
        return ("cat", items)

    return choice()


def reverse(tree: tuple) -> tuple:
    """The tree that reads the same words from the right."""
    if tree[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


def forbids(tree: tuple) -> int:
    """All classes that arcs of the tree exclude."""
    if tree[0] == "arc":
        return tree[2]
    return forbids(tree[1]) if tree[0] == "rep" else _union(map(forbids, tree[1]))


def _union(bits: Iterable[int]) -> int:
    out = 0
    for x in bits:
        out |= x
    return out


class Graph:
    """States, arcs ``(need, forbid, weight, target)`` and weighted empty moves of a machine; state 0 is its start."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[int, int, float, int]]] = []
        self.empty: list[list[tuple[float, int]]] = []
        self.state()

    def state(self) -> int:
        self.arcs.append([])
        self.empty.append([])
        return len(self.arcs) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Put a tree behind a state; the state where it ends."""
        kind = tree[0]
        if kind == "arc":
            end = self.state()
            self.arcs[start].append((tree[1], tree[2], tree[3], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                self.empty[self.add(part, start)].append((0.0, end))
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append((0.0, loop))
            self.empty[self.add(part, loop)].append((0.0, loop))
            self.empty[loop].append((0.0, end))
            return end
        end = self.state()
        self.empty[start].append((0.0, end))
        for _ in range(most - least):
            start = self.add(part, start)
            self.empty[start].append((0.0, end))
        return end

    def closed(self, states: dict[int, float]) -> dict[int, float]:
        """States with what empty moves reach, each with its greatest weight."""
        found, todo = dict(states), list(states)
        while todo:
            state = todo.pop()
            for weight, target in self.empty[state]:
                value = found[state] + weight
                if value > found.get(target, -1e9):
                    found[target] = value
                    todo.append(target)
        return found


class Symbols:
    """Readings of words, each distinct tuple of readings being one symbol; symbol 0 is the end of a clause."""

    def __init__(self) -> None:
        self.readings: list[tuple[Reading, ...]] = []
        self.numbers: dict[tuple[Reading, ...], int] = {}
        self.number(((EDGE, 0.0),))

    def number(self, readings: tuple[Reading, ...]) -> int:
        if readings not in self.numbers:
            self.numbers[readings] = len(self.readings)
            self.readings.append(readings)
        return self.numbers[readings]

    def without(self, symbol: int, bits: int) -> int:
        """The symbol with some classes taken off all its readings."""
        return self.number(tuple((classes & ~bits, weight) for classes, weight in self.readings[symbol]))


class Row(dict):
    """A state of a lazy automaton: symbol to (next row, weight put out)."""

    __slots__ = ("key", "machine")

    def __init__(self, machine, key):
        super().__init__()
        self.key, self.machine = key, machine

    def __missing__(self, symbol: int):
        step = self[symbol] = self.machine.step(self.key, symbol)
        return step


class Patterns:
    """The union of weighted patterns ``(kind, weight, tree)``, searched for anywhere in a clause."""

    def __init__(self, patterns: list[tuple[str, float, tuple]], symbols: Symbols):
        self.symbols, self.graph = symbols, Graph()
        self.kinds: dict[int, str] = {}
        finals = []
        for kind, weight, tree in patterns:
            end = self.graph.add(tree, 0)
            self.kinds[end] = kind
            self.graph.empty[end].append((weight, 0))
            finals.append((end, weight))
        self.promise = self._promises(finals)
        self.rows: dict[tuple, Row] = {}
        self.heads = self.graph.closed({0: 0.0})
        self.firsts: dict[int, dict[int, float]] = {}
        self.begin = self.row(self._moved({0: 0.0}, 0))

    def _promises(self, finals: list[tuple[int, float]]) -> list[float]:
        """The most that a path from each state still gains before it ends its pattern."""
        gain = [-1e9] * len(self.graph.arcs)
        for state, weight in finals:
            gain[state] = weight
        changed = True
        while changed:
            changed = False
            for state in range(1, len(gain)):
                ways = [(w, t) for _, _, w, t in self.graph.arcs[state]] + [x for x in self.graph.empty[state] if x[1]]
                best = max([gain[state], *(w + gain[t] for w, t in ways)])
                if best > gain[state]:
                    gain[state], changed = best, True
        return gain

    def row(self, states: dict[int, float]) -> Row:
        key = tuple(sorted(states.items()))
        if key not in self.rows:
            if len(self.rows) >= MOST_STATES:
                self.rows.clear()
            self.rows[key] = Row(self, key)
        return self.rows[key]

    def _arcs(self, state: int, symbol: int) -> Iterable[tuple[int, float]]:
        """(target, weight) of the arcs of a state that a symbol may take."""
        for need, forbid, gain, target in self.graph.arcs[state]:
            for classes, extra in self.symbols.readings[symbol]:
                if classes & need == need and not classes & forbid:
                    yield target, gain + extra

    def _first(self, symbol: int) -> dict[int, float]:
        """Where a symbol leads from the start of all patterns."""
        if symbol not in self.firsts:
            found: dict[int, float] = {}
            for state, weight in self.heads.items():
                for target, gain in self._arcs(state, symbol):
                    found[target] = max(found.get(target, -1e9), weight + gain)
            self.firsts[symbol] = found
        return self.firsts[symbol]

    def _moved(self, states: dict[int, float], symbol: int) -> dict[int, float]:
        """Where a symbol leads from some states; state 0, at weight 0, is always among them."""
        found = {0: 0.0, **self._first(symbol)}  # any word may be passed over
        for state, weight in self.graph.closed({s: w for s, w in states.items() if s}).items():
            if state not in self.heads:
                for target, gain in self._arcs(state, symbol):
                    found[target] = max(found.get(target, -1e9), weight + gain)
        return found

    def step(self, key: tuple, symbol: int) -> tuple[Row, float]:
        states = self.graph.closed(self._moved(dict(key), symbol))
        base = states[0]  # weights are kept relative to having passed everything over or ended all patterns
        if symbol == 0:
            return self.begin, round(base, 3)
        left = {
            s: round(w - base, 3)
            for s, w in states.items()
            if s and self.graph.arcs[s] and w - base + self.promise[s] > 0
        }
        return self.row({0: 0.0, **left}), round(base, 3)

    def score(self, symbols: list[int]) -> float:
        row, total = self.begin, 0.0
        for symbol in [*symbols, 0]:
            row, weight = row[symbol]
            total += weight
        return total

    def found(self, symbols: list[int]) -> set[str]:
        """Kinds of the patterns on the best path."""
        states: dict[int, tuple[float, frozenset]] = {0: (0.0, frozenset())}
        for symbol in [0, *symbols, 0]:
            total, kinds = states[0]
            after = {0: states[0]}
            for target, gain in self._first(symbol).items():
                after[target] = total + gain, kinds
            for state, (weight, kinds) in states.items():
                if state not in self.heads:
                    for target, gain in self._arcs(state, symbol):
                        if target not in after or weight + gain > after[target][0]:
                            after[target] = weight + gain, kinds
            todo = list(after)
            while todo:
                state = todo.pop()
                weight, kinds = after[state]
                for gain, target in self.graph.empty[state] if state else ():
                    if target not in after or weight + gain > after[target][0]:
                        after[target] = weight + gain, kinds | {self.kinds[state]} if not target else kinds
                        todo.append(target)
            states = after
        return set(states[0][1])


class _Seen:
    """A lazy automaton that tells which of several patterns end where it stands."""

    def __init__(self, trees: list[tuple], symbols: Symbols):
        self.symbols, self.graph = symbols, Graph()
        self.ends: dict[int, int] = {}
        for i, tree in enumerate(trees):
            end = self.graph.add(tree, 0)
            self.ends[end] = self.ends.get(end, 0) | 1 << i
        self.rows: dict[frozenset, Row] = {}

    def row(self, states: set[int]) -> Row:
        key = frozenset(states)
        if key not in self.rows:
            if len(self.rows) >= MOST_STATES:
                self.rows.clear()
            self.rows[key] = Row(self, key)
        return self.rows[key]

    def start(self) -> Row:
        return self.row({0})

    def step(self, key: frozenset, symbol: int) -> tuple[Row, int]:
        classes = _union(x for x, _ in self.symbols.readings[symbol])
        after = {0}
        for state in self.graph.closed(dict.fromkeys(key, 0.0)):
            for need, forbid, _, target in self.graph.arcs[state]:
                if classes & need == need and not classes & forbid:
                    after.add(target)
        ended = _union(self.ends.get(x, 0) for x in self.graph.closed(dict.fromkeys(after, 0.0)))
        return self.row(after), ended


class Contexts:
    """Rules ``(left, classes, right)``: between the two contexts a word loses the classes."""

    def __init__(self, rules: list[tuple[tuple, int, tuple]], symbols: Symbols):
        self.symbols = symbols
        self.bits = [bits for _, bits, _ in rules]
        empty = ("cat", [])
        self.open_left = _union(1 << i for i, (x, _, _) in enumerate(rules) if x == empty)
        self.open_right = _union(1 << i for i, (*_, x) in enumerate(rules) if x == empty)
        self.left = _Seen([x for x, _, _ in rules], symbols)
        self.right = _Seen([reverse(x) for *_, x in rules], symbols)

    def apply(self, symbols: list[int]) -> list[int]:
        row, ended = self.right.start()[0]
        after = []
        for symbol in reversed(symbols):
            after.append(ended | self.open_right)
            row, ended = row[symbol]
        out = []
        row, ended = self.left.start()[0]
        for symbol, follows in zip(symbols, reversed(after)):
            both, lost, i = (ended | self.open_left) & follows, 0, 0
            while both:
                if both & 1:
                    lost |= self.bits[i]
                both >>= 1
                i += 1
            out.append(self.symbols.without(symbol, lost) if lost else symbol)
            row, ended = row[symbol]
        return out


class Disguise:
    """A character transducer composed with the trie of ``words``: word to readings.

    ``arcs`` gives for a character the letters that it may stand for and their cost.  A mask stands for any one
    letter, though not for the first of a word; a letter may be drawn out.  The cheapest path through the trie counts.
    """

    MASKS = "*#"
    MASK_COST, REPEAT_COST = 0.05, 0.0

    def __init__(self, words: dict[str, int], arcs: dict[str, tuple[tuple[str, float], ...]]):
        self.arcs = arcs
        self.trie: list[dict[str, int]] = [{}]
        self.ends: dict[int, list[str]] = {}
        for word in words:
            node = 0
            for char in word:
                if char not in self.trie[node]:
                    self.trie.append({})
                    self.trie[node][char] = len(self.trie) - 1
                node = self.trie[node][char]
            self.ends.setdefault(node, []).append(word)

    def read(self, token: str, better: Callable[[str], int]) -> tuple[str, float] | None:
        """(word, weight) of the best reading; of equally cheap words the one that ``better`` ranks first."""
        # (node, last letter) to cost; masks that end a token must leave the last letter in sight.
        paths: dict[tuple[int, str], float] = {(0, ""): 0.0}
        for i, char in enumerate(token):
            after: dict[tuple[int, str], float] = {}
            options = ((char, 0.0), *self.arcs.get(char, ()))
            masked = char in self.MASKS and 0 < i < len(token) - 1
            for (node, last), cost in paths.items():
                if char == last or any(x == last for x, _ in options):
                    self._put(after, (node, last), cost + self.REPEAT_COST)
                if masked:
                    for letter, target in self.trie[node].items():
                        self._put(after, (target, ""), cost + self.MASK_COST)
                else:
                    for letter, price in options:
                        target = self.trie[node].get(letter)
                        if target is not None:
                            self._put(after, (target, letter), cost + price)
            paths = after
            if not paths:
                return None
        found = [(round(cost, 3), better(w), w) for (node, _), cost in paths.items() for w in self.ends.get(node, ())]
        if not found:
            return None
        cost, _, word = min(found)
        return word, -min(cost, 0.2)

    @staticmethod
    def _put(paths: dict, key: tuple[int, str], cost: float) -> None:
        if cost < paths.get(key, 1e9):
            paths[key] = cost
