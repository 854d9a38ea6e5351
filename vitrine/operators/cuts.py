"""Dictionary words in many texts at once, and the cheapest cuts into them: a task works on arrays of letters, not letter by letter."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from vitrine.functions.textclean import SARA_AA, SARA_AM, TONE_MARKS

#: Letters that a task has in arrays at one time; a run is never divided.
LETTERS_AT_ONCE = 300_000
# A way's price and, below it, how short its last word is; a letter outside words comes behind all words.
_BITS = 20
_LETTER = (1 << _BITS) - 1


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class WordTree:
    """Words by their beginnings: for each length, which beginnings go on with which letter, and which words end there."""

    #: Up to so many entries, the beginnings of one length are looked up in a table, above in a sorted list.
    TABLE = 1 << 22

    def __init__(self, words: Sequence[str]):
        self.words = list(words)
        codes, size = codes_of("".join(self.words)), np.array([len(w) for w in self.words], np.int64)
        alphabet = np.unique(codes)
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[alphabet] = np.arange(1, len(alphabet) + 1)
        self.n_letters = len(alphabet) + 1
        letters, first = self.letter[codes], np.cumsum(size) - size
        node, live, parents, self.levels = np.zeros(len(size), np.int64), np.arange(len(size)), 1, []
        for depth in range(int(size.max(initial=0))):
            live = live[size[live] > depth]
            known, node[live] = np.unique(node[live] * self.n_letters + letters[first[live] + depth], return_inverse=True)
            ends, last = np.full(len(known), -1), live[size[live] == depth + 1]
            ends[node[last]] = last
            table = None
            if parents * self.n_letters <= self.TABLE:
                table = np.full(parents * self.n_letters, -1, np.int32)
                table[known] = np.arange(len(known))
            self.levels.append((known, table, ends))
            parents = len(known)

    def found(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first letter, length, number of the word) of all words in ``letters``, numbers as in ``letter``, 0 for what ends every word."""
        padded, at, node, out = np.append(letters, np.zeros(len(self.levels) + 1, letters.dtype)), np.flatnonzero(letters), 0, []
        for depth, (known, table, ends) in enumerate(self.levels):
            key = node * self.n_letters + padded[at + depth].astype(np.int64)
            if table is not None:
                to = table[key]
            else:
                to = np.minimum(np.searchsorted(known, key), len(known) - 1)
                to = np.where(known[to] == key, to, -1)
            on = to >= 0
            at, node = at[on], to[on].astype(np.int64)
            word = ends[node]
            hit = word >= 0
            out.append((at[hit], np.full(int(hit.sum()), depth + 1), word[hit]))
            if not len(at):
                break
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip((none, none, none), *out))


class Runs:
    """Runs of a script in arrays: the letters of all runs without marks and spaces, with one end place behind each run."""

    def __init__(self, runs: Sequence[str]):
        codes = codes_of("\n".join([*runs, ""]))
        size = np.array([len(r) for r in runs], np.int64)
        is_end = np.zeros(len(codes), bool)
        is_end[np.cumsum(size + 1) - 1] = True
        space = (codes == ord(" ")) & ~is_end
        kept = np.flatnonzero(is_end | ~(space | np.isin(codes, codes_of(TONE_MARKS))))
        self.end = is_end[kept]
        #: Number of the run, and place in it; an end place is the run's length.
        self.run = np.cumsum(self.end) - self.end
        self.place = kept - (np.cumsum(size + 1) - size - 1)[self.run]
        #: The letter as it stands there, and as skeletons have it.
        self.written = codes[kept]
        self.codes = np.where((self.written == ord(SARA_AM)) & ~self.end, ord(SARA_AA), self.written)
        begins = np.append(True, self.end[:-1])[:len(kept)]
        #: Had the letter a space before it?
        self.spaced = space[kept - 1] & (kept > 0) & ~begins & ~self.end

    def letters(self, tree: WordTree) -> np.ndarray:
        return np.where(self.end, 0, tree.letter[self.codes])


class Cuts:
    """The cheapest cut of each run into words that cost ``price`` each, ``per_space`` more for each space inside, and letters for ``unknown`` each.

    Of equally cheap cuts the one with the longest last word wins, and a word before a letter. Places that no word crosses part a run into stretches; all stretches
    are cut together, one letter further in each step.
    """

    def __init__(self, runs: Runs, tree: WordTree, price: np.ndarray, unknown: int, per_space: int = 0):
        first, size, word = tree.found(runs.letters(tree))
        n, last = len(runs.end), first + size
        cost = price[word]
        if per_space:
            before = np.cumsum(runs.spaced)  # spaces up to and with this letter
            cost = cost + per_space * (before[last - 1] - before[first])
        crossed = np.bincount(first + 1, minlength=n + 1)[:n + 1] - np.bincount(last, minlength=n + 1)[:n + 1]
        whole = np.cumsum(crossed)[:n] == 0  # no word goes on across the border before this letter
        place = np.arange(n)
        step = place - np.maximum.accumulate(np.where(whole, place, 0))
        letters = np.flatnonzero(~runs.end)
        short = step.astype(np.int16) if step.max(initial=0) < 1 << 15 else step  # small numbers are sorted in one sweep
        letters = letters[np.argsort(short[letters], kind="stable")]
        order = np.argsort(short[first], kind="stable")
        first_, size_, last_, cost_ = first[order], size[order], last[order], cost[order]
        steps = int(step[letters].max(initial=-1)) + 1
        upto_l, upto_w = (np.searchsorted(step[x], np.arange(steps + 1)) for x in (letters, first_))
        best = np.full(n + 1, np.iinfo(np.int64).max)
        for i in range(steps):
            at = letters[upto_l[i]:upto_l[i + 1]]
            paid = best[at] >> _BITS if i else 0
            best[at + 1] = np.minimum(best[at + 1], ((paid + unknown) << _BITS) + _LETTER)
            some = slice(upto_w[i], upto_w[i + 1])
            at, to = first_[some], last_[some]
            paid = best[at] >> _BITS if i else 0
            best[to] = np.minimum(best[to], ((paid + cost_[some]) << _BITS) + _LETTER - size_[some])
        #: Places where stretches end, and what each stretch costs.
        self.ends = np.flatnonzero(whole[1:] & ~runs.end[:-1]) + 1
        self.cost = best[self.ends] >> _BITS
        self._best, self._step, self._found = best, step, (first, size, word)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first letter, end, number of the word or -1) of all parts, in order."""
        out, at = [], self.ends
        while len(at):
            size = _LETTER - (self._best[at] & _LETTER)
            begin = at - np.maximum(size, 1)
            out.append((begin, at, size))
            at = begin[self._step[begin] > 0]
        if not out:
            return (np.zeros(0, np.int64),) * 3
        begin, end, size = (np.concatenate(c) for c in zip(*out))
        order = np.argsort(begin)
        begin, end, size = begin[order], end[order], size[order]
        first, length, word = self._found
        longest = int(length.max(initial=0)) + 1
        key = first * longest + length
        order = np.argsort(key)
        number = np.full(len(begin), -1)
        known = size > 0
        number[known] = word[order][np.searchsorted(key[order], begin[known] * longest + size[known])]
        return begin, end, number
