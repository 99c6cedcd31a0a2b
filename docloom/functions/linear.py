"""A second matcher, linear in the text for every pattern: Arrow's pattern kernels, in batches of lines.

Java's matcher goes back on its steps, so patterns whose repeats can share their text in many ways may take it any time. Those are matched here, by automata
without backtracking. Classes that are Unicode's in the language are spelled out, as the kernels know ASCII ones only; word boundaries have no such
spelling and are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docloom.functions.patterns import Pattern, checked_text, ignores_case, runs_away
from docloom.schema import RequestError

#: Members of the language's classes, as inside of a bracket.
_CLASSES = {"w": r"\pL\pM\p{Nd}\p{Nl}\p{Pc}", "d": r"\p{Nd}", "s": r"\s\x{85}\p{Z}"}


def spelled(pattern: str) -> str:
    """The kernels' spelling of a pattern of the search language."""
    out, inside = [], False
    for token in re.finditer(r"\\[pP]\{[^}]*\}|\\.|\[\^?\]?|\]|.", pattern, re.S):
        t = token[0]
        kind = t[1:].lower() if len(t) == 2 and t[0] == "\\" else ""
        if kind in _CLASSES:
            positive = t[1].islower()
            if inside and not positive:
                raise RequestError("InvalidPattern", f"{t} inside of a class has no linear spelling")
            out.append(_CLASSES[kind] if inside else f"[{'' if positive else '^'}{_CLASSES[kind]}]")
        elif kind == "b" or t in (r"\G", r"\R", r"\X", r"\h", r"\H"):
            raise RequestError("InvalidPattern", f"{t} has no linear spelling")
        else:
            if not inside and t[0] == "[":
                inside = True
            elif inside and t == "]":
                inside = False
            out.append(t)
    return "".join(out)


@dataclass(frozen=True)
class LinearPattern:
    """A checked pattern for Arrow's kernels."""

    text: str
    case: str = "insensitive"

    def __post_init__(self) -> None:
        checked_text(self.text, "regex", self.case)
        try:
            empty = pc.match_substring_regex(pa.array([""]), self.re2)[0].as_py()
        except pa.ArrowInvalid as e:
            raise RequestError("InvalidPattern", str(e)) from None
        if empty:
            raise RequestError("InvalidPattern", "the pattern matches the empty string")

    @property
    def re2(self) -> str:
        return f"(?{'i' if ignores_case(self.text, 'regex', self.case) else ''}m)(?:{spelled(self.text)})"

    def counted(self, lines: DataFrame) -> DataFrame:
        """lines with matches: all columns of lines (text among them) and occurrence_count."""
        pattern = self.re2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column("text"), pattern), False))
                yield kept.append_column("occurrence_count", pc.count_substring_regex(kept.column("text"), pattern).cast(pa.int64()))

        return lines.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + ", occurrence_count bigint")


def pattern_of(text: str, syntax: str = "literal", case: str = "insensitive", word: bool = False) -> Pattern | LinearPattern:
    """The pattern for Java's matcher, or for the linear one if Java's may run away with it."""
    if syntax == "regex" and not word and runs_away(text):
        return LinearPattern(text, case)
    return Pattern(text, syntax, case, word)
