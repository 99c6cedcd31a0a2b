"""Search patterns: validation on the driver and their spelling for Java's regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.schema import MAX_PATTERN_BYTES, RequestError

SYNTAXES, CASES = ("literal", "regex"), ("insensitive", "sensitive", "smart")
#: Look-around, back-references, atomic groups and possessive quantifiers are no part of the language.
_REFUSED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+")


def nests_repeats(pattern: str) -> bool:
    """Whether an unbounded repeat stands around another, which a backtracking matcher may take exponential time for."""
    bare = re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]", "x", re.sub(r"\\.", "x", pattern, flags=re.S))
    groups = [False]  # whether each open group holds an unbounded repeat
    closed = False  # whether the last item was such a group
    for part in re.finditer(r"\((?:\?[^:)]*:)?|\)|[*+]|\{\d*,\d*\}|.", bare, re.S):
        token = part[0]
        if token[0] == "(":
            groups.append(False)
            closed = False
        elif token == ")" and len(groups) > 1:
            closed = groups.pop()
            groups[-1] |= closed
        elif token in "*+" or token[0] == "{" and token.endswith(",}"):
            if closed:
                return True
            groups[-1] = True
        else:
            closed = False
    return False


#: A pattern for Java's matcher has at most so many repeats without an end, and groups are counted up to so many times.
MAX_REPEATS, MAX_COUNTED_GROUP = 4, 8


def runs_away(pattern: str) -> bool:
    """Whether repeats can share a text in so many ways that a backtracking matcher may take very long."""
    bare = re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]", "x", re.sub(r"\\[pP]\{[^}]*\}|\\.", "x", pattern, flags=re.S))
    if len(re.findall(r"[*+]|\{\d*,\}", bare)) > MAX_REPEATS or nests_repeats(pattern):
        return True
    # a repeated group with alternatives or an optional part, or one that is counted often
    for group in re.finditer(r"\(([^()]*)\)(?:([*+]|\{\d*,\})|\{(\d+)(?:,(\d+))?\})", bare):
        if group[2] and re.search(r"[|?]|\{0?,", group[1].removeprefix("?:")) or not group[2] and int(group[4] or group[3]) > MAX_COUNTED_GROUP:
            return True
    return re.search(r"\)(?:[*+]|\{\d*,\}|\{\d{2,})", bare) is not None and re.search(r"\([^()]*\(", bare) is not None


def checked_text(text: str, syntax: str, case: str) -> None:
    """Refuse what no matcher takes."""
    if not text:
        raise RequestError("EmptyPattern", "the pattern is empty")
    if len(text.encode()) > MAX_PATTERN_BYTES:
        raise RequestError("PatternTooLong", f"the pattern has over {MAX_PATTERN_BYTES} bytes")
    if syntax not in SYNTAXES or case not in CASES:
        raise RequestError("InvalidPattern", f"unknown syntax or case: {syntax}, {case}")
    if syntax == "regex" and _REFUSED.search(re.sub(r"\\\\", "", text)):
        raise RequestError("InvalidPattern", "look-around and back-references are not supported")


def ignores_case(text: str, syntax: str, case: str) -> bool:
    """Smart case looks at literal characters: an upper-case one makes the search sensitive."""
    literal = text if syntax == "literal" else re.sub(r"\\(?:[pP]\{[^}]*\}|.)", "", text)
    return case == "insensitive" or case == "smart" and not any(c.isupper() for c in literal)


@dataclass(frozen=True)
class Pattern:
    """A checked pattern; `java` is its Java spelling with all flags."""

    text: str
    syntax: str = "literal"
    case: str = "insensitive"
    word: bool = False

    def __post_init__(self) -> None:
        checked_text(self.text, self.syntax, self.case)
        if self.syntax == "regex":
            if runs_away(self.text):
                raise RequestError("InvalidPattern", "repeats that may share their text in many ways need the linear matcher")
            try:
                found = re.compile(re.sub(r"\\[pP](?:\{[^}]*\}|\w)|\\[zZAhHR]", ".", self.text))
            except re.error as e:
                raise RequestError("InvalidPattern", str(e)) from None
            if found.match("") is not None and found.match("").end() == 0 and found.search("") is not None:
                raise RequestError("InvalidPattern", "the pattern matches the empty string")

    @property
    def ignores_case(self) -> bool:
        return ignores_case(self.text, self.syntax, self.case)

    @property
    def java(self) -> str:
        body = "\\Q" + self.text.replace("\\E", "\\E\\\\E\\Q") + "\\E" if self.syntax == "literal" else f"(?:{self.text})"
        if self.word:
            body = rf"(?<!\w){body}(?!\w)"
        return ("(?iu)" if self.ignores_case else "") + "(?U)(?md)" + body

    def matches(self, column: Column) -> Column:
        return column.rlike(self.java)

    def count(self, column: Column) -> Column:
        return F.regexp_count(column, F.lit(self.java)).cast("long")

    def occurrences(self, line: Column) -> Column:
        """All matches of a line: array of (text, start: characters before)."""
        found = F.regexp_extract_all(line, F.lit(self.java), F.lit(0))
        between = F.split(line, self.java, -1)
        # the n-th match starts after n+1 stretches between matches and n matches
        return F.transform(
            found,
            lambda text, n: F.struct(
                text.alias("text"),
                (F.aggregate(F.slice(between, F.lit(1), n + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(found, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))).cast("long").alias("start"),
            ),
        )
