"""Regular-expression rules as Column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}_]"
# Java's \b counts Thai tone marks as word characters; the rules expect letters, digits and "_" only.
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def portable(pattern: str, ignore_case: bool = True) -> str:
    """A rule pattern with a Unicode-aware word boundary, case folding over all scripts."""
    return ("(?iu)" if ignore_case else "") + pattern.replace(r"\b", _EDGE)


def matches(subject: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.coalesce(subject, F.lit("")).rlike(portable(pattern, ignore_case))


def first_match(subject: Column, rules: Sequence[tuple[str, str]], ignore_case: bool = True) -> Column:
    """Value of the first (pattern, value) rule that matches, else null: one CASE, stops at the hit."""
    chain = None
    for pattern, value in rules:
        test = matches(subject, pattern, ignore_case)
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain if chain is not None else F.lit(None).cast("string")


def all_matches(subject: Column, rules: Sequence[tuple[str, str]], ignore_case: bool = True) -> Column:
    """Values of every (pattern, value) rule that matches, in rule order."""
    return F.array_compact(F.array(*[
        F.when(matches(subject, p, ignore_case), F.lit(v)) for p, v in rules
    ])) if rules else F.array().cast("array<string>")


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, or null where the pattern or the group did not match."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def lookup_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def mapped(key: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(lookup_map(pairs), key)


def flags(*named: tuple[str, Column]) -> Column:
    """Array of the names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in named]))
