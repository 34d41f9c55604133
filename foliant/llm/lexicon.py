"""Candidate corrections: a Levenshtein automaton of the word intersected with a trie of the vocabulary.

The automaton of a word is simulated by bit vectors, one for each number of edits; a set bit is a state. Walking the
trie with it visits exactly the prefixes that some word within the distance may still grow from, so the retrieval is
complete. An edit inserts, deletes or replaces any letter; a stretch of two letters that prints like another is one edit,
too. Many words walk at once, their states in arrays. Words are compared by their decomposed (NFD) characters: a Korean
syllable is two or three letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: Words that walk a trie together, and pairs of a word and a node beyond which they go on in halves; results don't depend on them.
WALKERS, MOST_WALKING = 512, 400_000


def letters(word: str) -> str:
    return unicodedata.normalize("NFD", word)


class Trie:
    """Nodes in arrays: children by letter, the word that ends here, least and greatest number of letters below."""

    def __init__(self, words: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for w in words:
            at = 0
            for c in letters(w):
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                at = nxt
            self.word[at] = w
        n = len(self.children)
        self.least, self.most = [0 if w is not None else 1 << 30 for w in self.word], [0] * n
        for at in range(n - 1, -1, -1):  # children have greater numbers than their parents
            for nxt in self.children[at].values():
                self.least[at] = min(self.least[at], self.least[nxt] + 1)
                self.most[at] = max(self.most[at], self.most[nxt] + 1)

    def within(self, word: str, distance: int) -> list[tuple[str, int]]:
        """All words of the trie at most ``distance`` edits from the word, with their distance."""
        text = letters(word)
        m = len(text)
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | (1 << i)
        full, end = (1 << (m + 1)) - 1, 1 << m
        out: list[tuple[str, int]] = []
        stack = [(0, 0, tuple((1 << (j + 1)) - 1 for j in range(distance + 1)))]
        children, ends, least, most = self.children, self.word, self.least, self.most
        while stack:
            at, depth, states = stack.pop()
            if ends[at] is not None:
                for j, s in enumerate(states):
                    if s & end:
                        out.append((ends[at], j))
                        break
            for c, nxt in children[at].items():
                left = m - depth - 1
                if least[nxt] > left + distance or most[nxt] < left - distance:
                    continue
                mask = masks.get(c, 0)
                above = states[0]
                now = (above & mask) << 1
                fresh = [now]
                for s in states[1:]:
                    now = (((s & mask) << 1) | above | (above << 1) | (now << 1)) & full
                    fresh.append(now)
                    above = s
                if now:
                    stack.append((nxt, depth + 1, tuple(fresh)))
        return out

    def _flat(self) -> tuple[np.ndarray, ...]:
        """(children of all nodes, where those of a node begin, their number, letter before a node, two letters before it, greatest and least below)."""
        if not hasattr(self, "_arrays"):
            n = len(self.children)
            self.alphabet = sorted({c for kids in self.children for c in kids})
            number = {c: i for i, c in enumerate(self.alphabet)}
            kids = np.array([x for below in self.children for x in below.values()], np.int64)
            many = np.array([len(below) for below in self.children], np.int64)
            letter, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for at, below in enumerate(self.children):
                for c, nxt in below.items():
                    letter[nxt] = number[c]
                    two[nxt] = letter[at] * len(self.alphabet) + number[c] if at else -1
            ends = np.array([w is not None for w in self.word])
            self._arrays = kids, np.cumsum(many) - many, many, letter, two, np.array(self.least, np.int64), np.array(self.most, np.int64), ends
        return self._arrays

    def near(self, words: Sequence[str], distance: int, meant: dict[str, list[str]], open_ended: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in words, node, edits): all words of the trie at most ``distance`` edits from one of words, with the least number.
        One edit is a letter inserted, deleted or replaced, or a stretch exchanged as in meant (of at most two letters for at
        most two). open_ended: all words of the trie that something within the distance begins with, edits are of no use then."""
        texts = [letters(w) for w in words]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for begin in range(0, len(order), WALKERS):
            places = np.array(order[begin : begin + WALKERS])
            for at, node, edits in self._walk([texts[i] for i in places], distance, meant, open_ended):
                yield places[at], node, edits

    def _walk(self, texts: list[str], d: int, meant: dict[str, list[str]], open_ended: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        kids, first_kid, many, letter, two, least, most, ends = self._flat()
        kind = np.uint64 if max(map(len, texts)) <= 60 else object  # longer ones have their bits in Python's integers

        def table(width: int) -> np.ndarray:
            return np.zeros((len(texts), width), kind) if kind is not object else np.full((len(texts), width), 0, object)

        def bit(i: int):  # noqa: ANN202
            return kind(1 << i) if kind is not object else 1 << i

        # letters of these words and of what may stand for them have a column; all others share the empty one at 0
        targets = sorted({other for text in texts for i in range(len(text)) for x in (1, 2) for other in meant.get(text[i : i + x], ())})
        column = {c: i + 1 for i, c in enumerate(sorted({c for t in [*texts, *targets] for c in t}))}
        pair = {t: i + 1 for i, t in enumerate(t for t in targets if len(t) == 2)}
        same, merged, begun = table(len(column) + 1), table(len(column) + 1), table(len(column) + 1)
        split, exchanged = table(len(pair) + 1), table(len(pair) + 1)
        for row, text in enumerate(texts):
            for i, c in enumerate(text):
                same[row, column[c]] |= bit(i)
                for x in (1, 2):
                    for other in meant.get(text[i : i + x], ()) if i + x <= len(text) else ():
                        if len(other) == 2:
                            (split if x == 1 else exchanged)[row, pair[other]] |= bit(i)
                            begun[row, column[other[0]]] |= bit(i)
                        elif x == 2:
                            merged[row, column[other]] |= bit(i)
        columns = np.array([column.get(c, 0) for c in self.alphabet] or [0], np.int64)
        number = {c: i for i, c in enumerate(self.alphabet)}
        known = {number[t[0]] * len(self.alphabet) + number[t[1]]: i for t, i in pair.items() if t[0] in number and t[1] in number}
        codes = np.array(sorted(known), np.int64)
        ids = np.array([known[c] for c in codes], np.int64)
        long = np.array([len(t) for t in texts], np.int64)
        full, end = (np.array([bit(len(t) + 1) - bit(0) for t in texts], kind), np.array([bit(len(t)) for t in texts], kind))
        one, two_places = (1, 2) if kind is object else (kind(1), kind(2))  # by how many places a state moves
        at = np.arange(len(texts))
        stack = [(0, at, np.zeros(len(texts), np.int64), [np.array([bit(j + 1) - bit(0)] * len(texts), kind) & full for j in range(d + 1)], [table(1)[:, 0] for _ in range(d)])]
        while stack:
            depth, w, node, states, waiting = stack.pop()
            total = int(many[node].sum())
            if not total:
                continue
            if total > MOST_WALKING and len(w) > 1:
                half = len(w) // 2
                for part in (slice(half), slice(half, None)):
                    stack.append((depth, w[part], node[part], [s[part] for s in states], [q[part] for q in waiting]))
                continue
            # each goes on to all children
            source = np.repeat(np.arange(len(w)), many[node])
            rank = np.arange(total) - np.repeat(np.cumsum(many[node]) - many[node], many[node])
            nxt = kids[first_kid[node][source] + rank]
            if not open_ended:
                left = long[w[source]] - depth - 1
                fits = (least[nxt] <= left + d) & (most[nxt] >= left - d)
                source, nxt = source[fits], nxt[fits]
            v, c = w[source], columns[letter[nxt]]
            mask, merge, begin, bound = same[v, c], merged[v, c], begun[v, c], full[v]
            place = np.minimum(np.searchsorted(codes, two[nxt]), max(len(codes) - 1, 0))
            which = np.where(codes[place] == two[nxt], ids[place], 0) if len(codes) else np.zeros(len(nxt), np.int64)
            paired = np.flatnonzero(which)
            s1, s2 = split[v[paired], which[paired]], exchanged[v[paired], which[paired]]
            above = states[0][source]
            fresh, pending = [((above & mask) << one) & bound], []
            for j in range(1, d + 1):
                own = states[j][source]
                now = ((own & mask) << one) | above | (above << one) | (fresh[-1] << one) | ((above & merge) << two_places)
                if len(paired):
                    q = waiting[j - 1][source[paired]]
                    now[paired] |= ((q & s1) << one) | ((q & s2) << two_places)
                fresh.append(now & bound)
                pending.append(above & begin)
                above = own
            live = fresh[-1] != 0  # the states of fewer edits are among those of more
            if d:
                live |= pending[-1] != 0
            if open_ended:
                arrived = np.flatnonzero(live & ends[nxt])
                edits = np.zeros(len(arrived), np.int64)
            else:
                arrived = np.flatnonzero(((fresh[-1] & end[v]) != 0) & ends[nxt])
                edits = np.full(len(arrived), d)
                for j in range(d - 1, -1, -1):
                    edits[(fresh[j][arrived] & end[v[arrived]]) != 0] = j
            if len(arrived):
                yield v[arrived], nxt[arrived], edits
            go = np.flatnonzero(live & (many[nxt] > 0))
            stack.append((depth + 1, v[go], nxt[go], [s[go] for s in fresh], [q[go] for q in pending]))

    def look_alikes(self, words: Sequence[str], meant: dict[str, list[str]], most: int) -> Iterator[tuple[int, str, int]]:
        """(place in words, other, exchanges): the words that the automaton finds within ``most`` edits of one of words and that at most
        as many exchanges of stretches explain."""
        chained = chains(meant)
        for places, nodes, _ in self.near(words, most, meant):
            for i, node in zip(places.tolist(), nodes.tolist(), strict=True):
                n = exchanges(words[i], self.word[node], chained, most)
                if n:
                    yield i, self.word[node], n

    def alike(self, word: str, meant: dict[str, list[str]], most: int) -> list[tuple[str, int]]:
        """All other words of the trie within ``most`` edits of the word that exchanges explain, with the least number of these."""
        return [(other, n) for _, other, n in self.look_alikes([word], meant, most)]


_CHAINS: dict[int, tuple[dict[str, list[str]], dict[str, list[tuple[str, int]]]]] = {}


def chains(meant: dict[str, list[str]]) -> dict[str, list[tuple[str, int]]]:
    """For a stretch what may stand for it and after how many exchanges: one as in meant, or two of which the second takes up
    letters that the first has made ("0" for "o" for "a", "cl" for "d" and then "h" for "li")."""
    if id(meant) not in _CHAINS:
        best = {(seen, other): 1 for seen, others in meant.items() for other in others}
        for seen, mids in meant.items():
            for mid in mids:
                for taken, others in meant.items():
                    # the second stretch begins at a letter of the first one's result, or before it and reaches into it
                    for shift in range(1 - len(taken), len(mid)):
                        before, after = taken[: max(0, -shift)], taken[max(0, len(mid) - shift) :]
                        if (before + mid + after)[max(0, shift) :].startswith(taken):
                            whole, lead, rest = before + mid + after, max(0, shift), max(0, shift) + len(taken)
                            for other in others:
                                x, y = before + seen + after, whole[:lead] + other + whole[rest:]
                                if x != y and len(x) <= 3 and len(y) <= 3:
                                    best.setdefault((x, y), 2)
        out: dict[str, list[tuple[str, int]]] = {}
        for (x, y), n in best.items():
            out.setdefault(x, []).append((y, n))
        _CHAINS[id(meant)] = meant, out
    return _CHAINS[id(meant)][1]


def exchanges(seen: str, meant: str, chained: dict[str, list[tuple[str, int]]], most: int) -> int | None:
    """The least number of exchanges, as in chained, that turn one word into the other; None if more than ``most`` are needed."""
    a, b = letters(seen), letters(meant)
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    # a stretch may begin up to two letters before the first difference ("rrn" for "rm")
    start = max(0, start - 2)
    best = {(start, start): 0}
    todo = [(start, start)]
    while todo:
        i, j = todo.pop()
        n = best[i, j]
        steps = [(i + 1, j + 1, n)] if a[i : i + 1] == b[j : j + 1] != "" else []
        if n < most:
            steps += [(i + x, j + len(y), n + k) for x in (1, 2, 3) if i + x <= len(a) for y, k in chained.get(a[i : i + x], ()) if n + k <= most and b.startswith(y, j)]
        for p, q, k in steps:
            if k < best.get((p, q), most + 1):
                best[p, q] = k
                todo.append((p, q))
    return best.get((len(a), len(b)))


def prefixes(word: str, meant: dict[str, list[str]], most: int, length: int) -> set[str]:
    """The first letters (``length`` of them, or all of a shorter word) of everything that comes of exchanging at most ``most``
    stretches of the word: the parts of a vocabulary that its automaton can reach."""
    text = letters(word)
    out: set[str] = set()
    seen, todo = {("", 0, 0)}, [("", 0, 0)]
    while todo:
        begun, i, n = todo.pop()
        if len(begun) >= length or i == len(text):
            out.add(begun[:length])
            continue
        steps = [(begun + text[i], i + 1, n)]
        if n < most:
            steps += [(begun + other, i + x, n + 1) for x in (1, 2) if i + x <= len(text) for other in meant.get(text[i : i + x], ())]
        for step in steps:
            if step not in seen:
                seen.add(step)
                todo.append(step)
    return out


def swaps(seen: str, meant: str, pairs: frozenset[tuple[str, str]], most: int) -> int | None:
    """The least number of stretches to exchange by ``pairs`` (seen, meant) that turn one word into the other; None if
    the pairs don't explain the difference or more than ``most`` are needed."""
    a, b = letters(seen), letters(meant)
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    # a stretch may begin up to two letters before the first difference ("rrn" for "rm")
    start = max(0, start - 2)
    best = {(start, start): 0}
    todo = [(start, start)]
    while todo:
        i, j = todo.pop()
        n = best[i, j]
        if i == len(a) and j == len(b):
            continue
        steps = []
        if i < len(a) and j < len(b) and a[i] == b[j]:
            steps.append((i + 1, j + 1, n))
        if n < most:
            for x in (1, 2):
                for y in (1, 2):
                    if i + x <= len(a) and j + y <= len(b) and (a[i : i + x], b[j : j + y]) in pairs:
                        steps.append((i + x, j + y, n + 1))
        for p, q, k in steps:
            if k < best.get((p, q), most + 1):
                best[p, q] = k
                todo.append((p, q))
    return best.get((len(a), len(b)))


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether two short strings are at most so many edits apart."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return False
    return row[-1] <= most
