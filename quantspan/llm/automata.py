"""Levenshtein automata intersected with a trie of terms, as one transition table.

A state of the intersection is a set of (trie node, edits so far). Subset construction turns
all reachable sets into rows of a table, so that any number of words advance by one gather
per character. Terms are stems (any ending may follow) or, with the end mark, whole words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END = "$"
DEAD, STOPPED = 0, 1


def allowed_edits(term: str) -> int:
    """No edit below 5 letters, one below 9, else two."""
    n = len(term.rstrip(END))
    return 0 if n < 5 else 1 if n < 9 else 2


@dataclass
class Automaton:
    table: np.ndarray  # state x class -> state
    term: np.ndarray  # of each state: the accepted term, -1 for none
    edits: np.ndarray
    final: np.ndarray  # nothing after this state changes its outcome
    classes: np.ndarray  # code point of the first plane (lower case) -> class; 0 is any other
    start: int
    end: int

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of the words that match, in order of word."""
        state = np.full(len(starts), self.start, np.int32)
        live, at = np.arange(len(starts)), starts.copy()
        found_word, found_state = [], []
        while len(live):
            over = at >= ends[live]
            if over.any():
                last = self.table[state[over], self.end]
                found_word.append(live[over])
                found_state.append(last)
                live, at, state = live[~over], at[~over], state[~over]
            state = self.table[state, self.classes[np.minimum(codes[at], 0xFFFF)]]
            done = self.final[state]
            if done.any():
                found_word.append(live[done])
                found_state.append(state[done])
                live, at, state = live[~done], at[~done], state[~done]
            at = at + 1
        word = np.concatenate(found_word) if found_word else np.zeros(0, np.int64)
        state = np.concatenate(found_state) if found_state else np.zeros(0, np.int32)
        hit = self.term[state] >= 0
        order = np.argsort(word[hit], kind="stable")
        word, state = word[hit][order], state[hit][order]
        return word, self.term[state], self.edits[state]


def build(terms: list[str], edits=allowed_edits) -> Automaton:
    """The table for lower-case terms; an empty list accepts nothing."""
    child: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    for i, t in enumerate(terms):
        node = 0
        for c in t:
            if c not in child[node]:
                child[node][c] = len(child)
                child.append({})
            node = child[node][c]
        ends[node] = i
    limit = [edits(t) for t in terms]
    room = [-1] * len(child)  # the most edits of any term below a node
    for node in range(len(child) - 1, -1, -1):
        below = [room[n] for n in child[node].values()]
        room[node] = max([limit[ends[node]] if node in ends else -1, *below])

    def closed(pairs: dict[int, int], accepted: tuple[int, int] | None) -> tuple:
        """Add deletions, keep the fewest edits per node, move accepted stems aside."""
        todo = list(pairs.items())
        while todo:
            node, e = todo.pop()
            if pairs.get(node, 99) < e:
                continue
            for c, n in child[node].items():
                if c != END and e + 1 <= room[n] and e + 1 < pairs.get(n, 99):
                    pairs[n] = e + 1
                    todo.append((n, e + 1))
        for node, e in pairs.items():
            i = ends.get(node)
            if i is not None and e <= limit[i] and (accepted is None or (e, i) < accepted):
                accepted = (e, i)
        best = accepted[0] if accepted else 99
        return tuple(sorted((n, e) for n, e in pairs.items() if e < best and child[n])), accepted

    def moved(state: tuple, c: str | None) -> tuple:
        pairs: dict[int, int] = {}

        def put(n, e):
            if e <= room[n] and e < pairs.get(n, 99):
                pairs[n] = e

        for node, e in state[0]:
            for d, n in child[node].items():
                if d == c:
                    put(n, e)
                elif c != END and d != END:
                    put(n, e + 1)
            if c != END:
                put(node, e + 1)
        return closed(pairs, state[1])

    letters = sorted({c for t in terms for c in t if c != END})
    number = {c: i + 1 for i, c in enumerate(letters)}
    end = len(letters) + 1
    start = closed({0: 0} if terms else {}, None)
    states: dict[tuple, int] = {((), None): DEAD}
    states.setdefault(start, len(states))
    rows, queue = [], list(states)
    for state in queue:
        reach = {c for n, _ in state[0] for c in child[n]} | {c for n, _ in state[0] for m in child[n].values() for c in child[m]}
        row = {None: moved(state, None)} | {c: moved(state, c) for c in reach if c != END} | {END: moved(state, END)}
        out = {}
        for c, to in row.items():
            if to not in states:
                states[to] = len(states)
                queue.append(to)
            out[c] = states[to]
        line = np.full(end + 1, out[None], np.int32)
        for c, to in out.items():
            if c is not None:
                line[end if c == END else number[c]] = to
        rows.append(line)
    classes = np.zeros(1 << 16, np.int32)
    for i in range(1 << 16):
        classes[i] = number.get(chr(i).lower(), 0)
    accepted = [s[1] for s in states]
    return Automaton(
        table=np.stack(rows),
        term=np.array([a[1] if a else -1 for a in accepted]),
        edits=np.array([a[0] if a else 0 for a in accepted]),
        final=np.array([not s[0] for s in states]),
        classes=classes,
        start=states[start],
        end=end,
    )
