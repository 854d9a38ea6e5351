"""Glossaries of any length over whole texts: each text meets only the phrases that it can hold.

The result is that of replacing all phrases one after the other, longest first. An automaton finds which phrases occur; they are replaced in that order. A replaced text can
hold a phrase that it did not hold before only if the phrase lies inside a translation or reaches across its border, which is a space; where the glossary has such
phrases, the text is searched again after each replacement.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.language import THAI, tidy_translation


class Replacer:
    """Phrases in the order in which they are replaced: longest first, then as given."""

    def __init__(self, phrases: Sequence[tuple[str, str]]):
        import ahocorasick

        ordered = sorted(phrases, key=lambda p: -len(p[0]))
        self.sources, self.targets = [s for s, _ in ordered], [f" {t} " for _, t in ordered]
        self.find = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for i, source in enumerate(self.sources):
            if source:
                places.setdefault(source, []).append(i)
        for source, at in places.items():
            self.find.add_word(source, at)
        if len(self.find):
            self.find.make_automaton()
        inside = len(self.find) and any(True for t in set(self.targets) for _ in self.find.iter(t))
        self.again = bool(inside) or any(" " in s for s in self.sources)

    def __call__(self, text: str | None) -> str | None:
        if not text or not len(self.find):
            return text
        found, last = self._found(text, -1), -1
        while found:
            i = found.pop(0)
            if self.sources[i] not in text:  # a longer phrase took it away
                continue
            text, last = text.replace(self.sources[i], self.targets[i]), i
            if self.again:
                found = self._found(text, last)
        return text

    def _found(self, text: str, last: int) -> list[int]:
        """Phrases behind ``last`` that occur, in order."""
        return sorted({i for _, at in self.find.iter(text) for i in at if i > last})


def replaced_phrases(text: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """``text`` after all phrases, in Arrow batches. Empty phrases replace nothing."""
    plain, key = list(phrases), uuid.uuid4().hex

    @F.pandas_udf(T.StringType())
    def replace(texts: pd.Series) -> pd.Series:
        return texts.map(_replacer(key, plain))

    return replace(text)


_kept: dict[str, Replacer] = {}


def _replacer(key: str, phrases: list[tuple[str, str]]) -> Replacer:
    """The automaton of a task, made once for all its batches."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = Replacer(phrases)
    return _kept[key]


def translate_texts(text: Column, phrases: Sequence[tuple[str, str]], foreign: str = THAI) -> Column:
    """``language.translate_phrases`` for a column of long texts or a long glossary; it cannot stand inside a lambda."""
    return tidy_translation(text, replaced_phrases(text, phrases), foreign)
