"""BPE as a deterministic automaton over tokens, compiled from a merge list by successive merge gadgets.

The automaton starts as one state with a loop for each base symbol. The gadget of a merge (u, v) -> w gives the
state that u leads to its own copy without the arc v, and adds the arc w wherever u and then v could be read; w
leads to where v led. All arcs with one label lead to one state, so a state is named by the token just read. What
gadgets take away is kept as removed[(u, v)] = rank; what a state had when it was copied follows from the ranks:
arc t leaves the state of u unless some merge (x, y), x on the right spine of u and y on the left spine of t, came
before the tokens that enclose x and y. A pair's answer is computed once and then read from the transition table.

A word's only accepted path is its BPE encoding. Encoding follows the longest arc first and steps back where none is
left; places from which no path goes on are remembered, so that long words take no more than one visit of each.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex

#: What the vocabulary's pre-tokenizer matches, and what counts as white space there.
_SPACE = r"\t-\r\x20\x85\xA0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_END, _LAST = "</w>", "\n"


#: Transitions that a process keeps at most.
TRANSITIONS = 1_000_000


def _symbols(token: str) -> str:
    """A token with its word end as one character that no byte letter is."""
    return token.removesuffix(_END) + _LAST if token.endswith(_END) else token


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter for each byte: itself if printable in Latin-1, else the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Automaton:
    """Encodes and decodes with the vocabulary file at path (a BPE with word ends, lower case)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.labels = {i: s for s, i in (vocab | self.added).items()}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}
        self.ids = {_symbols(s): i for s, i in vocab.items() if len(s.removesuffix(_END)) == 1}
        for k, (u, v) in enumerate(model["merges"]):
            self._gadget(k, vocab[u], vocab[v], vocab[u + v])
        self.table: dict[int, bool] = {}
        self.reach: dict[str, int] = {}
        for s in self.ids:
            self.reach[s[:3]] = max(len(s), self.reach.get(s[:3], 0))

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """Merge (u, v) into w; w gets an arc only if v can follow u in the automaton so far."""
        if self._arc(u, v):
            self.ids[_symbols(self.labels[w])] = w
        self.removed.setdefault((u, v), rank)
        self.left[w], self.right[w], self.rank[w] = u, v, rank

    def _arc(self, u: int, t: int) -> bool:
        """Whether arc t leaves the state of u."""
        x, before_x = u, len(self.removed) + 1
        while x is not None:
            y, before_y = t, len(self.removed) + 1
            while y is not None:
                r = self.removed.get((x, y))
                if r is not None and r < before_x and r <= before_y:
                    return False
                before_y, y = self.rank.get(y, -1), self.left.get(y)
            before_x, x = self.rank.get(x, -1), self.right.get(x)
        return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word in byte letters."""
        s = word + _LAST
        ids, table, reach, n = self.ids, self.table, self.reach, len(s)
        if (whole := ids.get(s)) is not None:
            return [whole]
        path: list[int] = []
        ends = [0]
        dead: set[tuple[int, int]] = set()
        at, stop = 0, n - 1
        while at < n:
            u = path[-1] if path else -1
            top = at + reach.get(s[at : at + 3], 2)
            if stop < top:
                top = stop
            for j in range(top, at, -1):
                t = ids.get(s[at:j])
                if t is None or dead and (j, t) in dead:
                    continue
                if u >= 0:
                    if (ok := table.get(key := u << 20 | t)) is None:
                        ok = self._arc(u, t)
                        if len(table) < TRANSITIONS:
                            table[key] = ok
                    if not ok:
                        continue
                path.append(t)
                ends.append(j)
                at, stop = j, n
                break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a base symbol")
                dead.add((at, path.pop()))
                ends.pop()
                stop, at = at - 1, ends[-1]
        return path

    def split(self, chunk: str) -> list[str | int]:
        """Pre-split words in byte letters, and the ids of added tokens, of a text."""
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(chunk) if self.specials else ():
            out += self._plain(chunk[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(chunk[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            if text.isalpha():
                return [text.lower()]
            if text[:-1].isalpha() and text[-1:] in ".,!?;:":
                return [text[:-1].lower(), text[-1]]
            found = _SPLIT.findall(text.lower())
            if text.isprintable():
                return found
        else:
            text = unicodedata.normalize("NFC", text)
            # As each letter by itself; only a sigma's form depends on its neighbours.
            low = text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)
            if low.isalpha():
                found = [low]
            elif low[:-1].isalpha() and low[-1] in ".,!?;:":
                found = [low[:-1], low[-1]]
            else:
                found = _SPLIT.findall(low)
        letters = byte_letters()
        return ["".join([letters[b] for b in w.encode()]) for w in found]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for w in self.split(text):
            out += [w] if isinstance(w, int) else self.encode_word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The arc labels, joined by spaces, as the vocabulary file names no decoder."""
        return " ".join(self.labels[i] for i in ids)


@lru_cache(2)
def automaton(path: str) -> Automaton:
    return Automaton(path)
