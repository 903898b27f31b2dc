"""Sorted vocabularies as tries, minimal automata, transducers and blocks.

All are views of one sorted list of distinct words, small enough for a task: a
trie's node is a range of the list and a depth, so nothing is built for it; an
automaton is compiled from such ranges bottom-up, equal continuations once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

# The size model of a trie's node and edge and of a transducer's arc, in bytes.
NODE_BYTES, EDGE_BYTES, ARC_BYTES = 40, 48, 5


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    return len(commonprefix([a, b]))


@dataclass(frozen=True)
class Node:
    """The words [lo, hi), which share their first ``depth`` letters."""

    lo: int
    hi: int
    depth: int


@dataclass
class Walk:
    """What a search in a trie or transducer found and cost."""

    words: list = field(default_factory=list)
    visited: int = 0
    followed: int = 0
    pruned: int = 0


class Trie:
    def __init__(self, words):
        self.words = sorted(set(words))
        self.root = Node(0, len(self.words), 0)

    def __len__(self) -> int:
        return len(self.words)

    def ends(self, node: Node) -> bool:
        """Whether a word ends at the node; it is the first of the range."""
        return node.lo < node.hi and len(self.words[node.lo]) == node.depth

    def children(self, node: Node) -> Iterator[tuple[str, Node]]:
        at = node.lo + self.ends(node)
        while at < node.hi:
            letter = self.words[at][node.depth]
            end = bisect_right(self.words, letter, at, node.hi, key=lambda w: w[node.depth])
            yield letter, Node(at, end, node.depth + 1)
            at = end

    def walk(self, prefix: str) -> tuple[Node | None, int]:
        """The node of a prefix, and the letters looked at; None where no word has it."""
        node = self.root
        for steps, letter in enumerate(prefix, 1):
            lo = node.lo + self.ends(node)
            lo = bisect_left(self.words, letter, lo, node.hi, key=lambda w: w[steps - 1])
            hi = bisect_right(self.words, letter, lo, node.hi, key=lambda w: w[steps - 1])
            if lo == hi:
                return None, steps
            node = Node(lo, hi, steps)
        return node, len(prefix)

    def contains(self, word: str) -> tuple[bool, int]:
        node, steps = self.walk(word)
        return node is not None and self.ends(node), steps

    def collect(self, node: Node, most: int | None = None) -> list[str]:
        return self.words[node.lo : node.hi if most is None else min(node.hi, node.lo + most)]

    def prefix_search(self, prefix: str, most: int | None = None) -> Walk:
        node, steps = self.walk(prefix)
        if node is None:
            return Walk(visited=steps)
        return Walk(self.collect(node, most), steps + self.nodes(node))

    def nodes(self, node: Node | None = None) -> int:
        """Nodes below and with a node: each word adds the letters that it doesn't share with the word before."""
        node = node or self.root
        some = self.words[node.lo : node.hi]
        return 1 + sum(len(w) - max(node.depth, shared(w, before)) for before, w in zip(["", *some], some, strict=False))

    def edges(self) -> int:
        return self.nodes() - 1

    def estimated_bytes(self) -> int:
        return self.nodes() * NODE_BYTES + self.edges() * EDGE_BYTES

    def within(self, automaton, most: int | None = None) -> Walk:
        """The words that a distance automaton accepts; subtrees in which it is dead are left out."""
        out, todo = Walk(), [(self.root, automaton.start)]
        while todo and (most is None or len(out.words) < most):
            node, state = todo.pop()
            out.visited += 1
            if self.ends(node) and automaton.accepts_state(state):
                out.words.append(self.words[node.lo])
            on = []
            for letter, child in self.children(node):
                out.followed += 1
                after = automaton.step(state, letter)
                if automaton.is_dead(after):
                    out.pruned += 1
                else:
                    on.append((child, after))
            todo += reversed(on)
        return out

    def graph(self, most: int = 400) -> dict:
        """Nodes and edges for drawing, breadth first, ``most`` nodes at most."""
        nodes, edges, todo, made = [], [], [("ROOT", self.root, None)], 0
        while todo and len(nodes) < most:
            label, node, above = todo.pop(0)
            nodes.append({"id": made, "label": label, "terminal": self.ends(node), "depth": node.depth})
            if above is not None:
                edges.append({"from": above, "to": made, "label": label})
            todo += [(letter, child, made) for letter, child in self.children(node)]
            made += 1
        return {"nodes": nodes, "edges": edges, "truncated": bool(todo)}


@dataclass(frozen=True)
class State:
    """A state of an automaton: what it adds if a word ends here (None: none does), and (letter, state, output) arcs."""

    final: int | None
    arcs: tuple[tuple[str, int, int], ...]


class Transducer:
    """The minimal automaton of sorted words, each with a whole number that its arcs add up to.

    An arc carries the least number below it that no arc before has given, so
    states with equal continuations are one. Without numbers it is the minimal
    acyclic automaton of the words.
    """

    def __init__(self, words: list[str], outputs: list[int] | None = None):
        if any(a >= b for a, b in zip(words, words[1:], strict=False)):
            raise ValueError("the words must be sorted and distinct")
        self.words, self.outputs = words, outputs or [0] * len(words)
        self.states: list[State] = []
        self.reused = 0
        self._known: dict[State, int] = {}
        self.start = self._compile(0, len(words), 0, 0)

    def _compile(self, lo: int, hi: int, depth: int, given: int) -> int:
        """The state of the words [lo, hi) behind their first letters, which have given ``given``."""
        final, arcs = None, []
        if lo < hi and len(self.words[lo]) == depth:
            final, lo = self.outputs[lo] - given, lo + 1
        while lo < hi:
            letter = self.words[lo][depth]
            end = bisect_right(self.words, letter, lo, hi, key=lambda w: w[depth])
            least = min(self.outputs[lo:end])
            arcs.append((letter, self._compile(lo, end, depth + 1, least), least - given))
            lo = end
        state = State(final, tuple(arcs))
        if state in self._known:
            self.reused += 1
        else:
            self._known[state] = len(self.states)
            self.states.append(state)
        return self._known[state]

    def arcs(self) -> int:
        return sum(len(s.arcs) for s in self.states)

    def estimated_bytes(self) -> int:
        return self.arcs() * ARC_BYTES

    def step(self, state: int, letter: str) -> tuple[int, int] | None:
        return next(((to, out) for x, to, out in self.states[state].arcs if x == letter), None)

    def seek(self, prefix: str) -> tuple[int | None, int, int]:
        """(state, output so far, letters looked at) of a prefix."""
        state, total = self.start, 0
        for steps, letter in enumerate(prefix, 1):
            if (arc := self.step(state, letter)) is None:
                return None, 0, steps
            state, total = arc[0], total + arc[1]
        return state, total, len(prefix)

    def get(self, word: str) -> int | None:
        state, total, _ = self.seek(word)
        return None if state is None or self.states[state].final is None else total + self.states[state].final

    def trace(self, word: str) -> list[dict]:
        """Each arc taken for a word, with the sum so far."""
        state, total, steps = self.start, 0, []
        for letter in word:
            if (arc := self.step(state, letter)) is None:
                break
            total += arc[1]
            steps.append({"label": letter, "from": state, "to": arc[0], "output": arc[1], "running": total})
            state = arc[0]
        return steps

    def under(self, prefix: str = "", most: int | None = None) -> list[tuple[str, int]]:
        """(word, output) of the words with a prefix, in order."""
        state, total, _ = self.seek(prefix)
        out, todo = [], [] if state is None else [(state, prefix, total)]
        while todo and (most is None or len(out) < most):
            at, word, total = todo.pop()
            if self.states[at].final is not None:
                out.append((word, total + self.states[at].final))
            todo += [(to, word + letter, total + more) for letter, to, more in reversed(self.states[at].arcs)]
        return out

    def within(self, automaton, most: int | None = None) -> Walk:
        """(word, output) of the words that a distance automaton accepts."""
        out, todo = Walk(), [(self.start, automaton.start, "", 0)]
        while todo and (most is None or len(out.words) < most):
            at, state, word, total = todo.pop()
            out.visited += 1
            if self.states[at].final is not None and automaton.accepts_state(state):
                out.words.append((word, total + self.states[at].final))
            on = []
            for letter, to, more in self.states[at].arcs:
                after = automaton.step(state, letter)
                if automaton.is_dead(after):
                    out.pruned += 1
                else:
                    out.followed += 1
                    on.append((to, after, word + letter, total + more))
            todo += reversed(on)
        return out

    def graph(self) -> dict:
        """Nodes with their least distance from the start, and edges."""
        depth, todo = {self.start: 0}, [self.start]
        for at in todo:
            for _, to, _ in self.states[at].arcs:
                if to not in depth:
                    depth[to] = depth[at] + 1
                    todo.append(to)
        nodes = [{"id": k, "final": s.final, "depth": depth[k]} for k, s in enumerate(self.states)]
        return {"nodes": nodes, "edges": [{"from": k, "to": to, "label": x, "output": out} for k, s in enumerate(self.states) for x, to, out in s.arcs]}


def ordinal_transducer(words: list[str]) -> Transducer:
    """Each word's place in the order."""
    return Transducer(words, list(range(len(words))))


def merged(words) -> dict[str, int]:
    """Nodes and edges of the trie and of the minimal automaton of words."""
    trie = Trie(words)
    small = Transducer(trie.words)
    return {"trie_nodes": trie.nodes(), "trie_edges": trie.edges(), "states": len(small.states), "arcs": small.arcs()}


def scan(words, automaton) -> Walk:
    """Every word through a distance automaton, each given up as soon as it is dead."""
    out = Walk()
    for word in words:
        state = automaton.start
        for letter in word:
            state = automaton.step(state, letter)
            out.followed += 1
            if automaton.is_dead(state):
                out.pruned += 1
                break
        else:
            if automaton.accepts_state(state):
                out.words.append(word)
        out.visited += 1
    return out


@dataclass(frozen=True)
class Block:
    number: int
    words: tuple[str, ...]
    offset: int

    @property
    def prefix(self) -> str:
        return commonprefix([self.words[0], self.words[-1]])

    @property
    def bytes(self) -> int:
        """Front-coded: a byte each for the shared length and the rest's, and the rest."""
        return sum(2 + len(w) - shared(before, w) for before, w in zip(["", *self.words], self.words, strict=False))

    @property
    def raw_bytes(self) -> int:
        return sum(1 + len(w) for w in self.words)


class BlockTree:
    """Sorted words in blocks of a fixed size; the first word of each is the index."""

    def __init__(self, words: list[str], size: int = 8):
        self.size, self.blocks, offset = size, [], 0
        for k in range(0, len(words), size):
            self.blocks.append(Block(k // size, tuple(words[k : k + size]), offset))
            offset += self.blocks[-1].bytes
        self.bytes = offset
        self.firsts = [b.words[0] for b in self.blocks]

    def index(self) -> Transducer:
        """First words to block numbers: what stays in memory."""
        return Transducer(self.firsts, [b.number for b in self.blocks])

    def lookup(self, word: str) -> dict:
        """Block, place in it and ordinal of a word, and the words compared in its block."""
        number = bisect_right(self.firsts, word) - 1
        place, compared = -1, 0
        if number >= 0:
            words = self.blocks[number].words
            at = bisect_left(words, word)
            compared = min(at + 1, len(words))
            place = at if at < len(words) and words[at] == word else -1
        return {"found": place >= 0, "block": number, "place": place, "ordinal": number * self.size + place if place >= 0 else -1, "compared": compared}

    def prefix_scan(self, prefix: str, most: int | None = None) -> tuple[list[str], int]:
        """(words, blocks read) of a prefix, from the block where it would stand."""
        number, words, read = max(0, bisect_right(self.firsts, prefix) - 1), [], 0
        while number < len(self.blocks) and (most is None or len(words) < most):
            first = self.firsts[number]
            if first > prefix and not first.startswith(prefix):
                break
            words += [w for w in self.blocks[number].words if w.startswith(prefix)]
            number, read = number + 1, read + 1
        return words[:most], read
