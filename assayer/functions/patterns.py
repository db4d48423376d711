"""What can be known of a pattern before any text is read: literals that all its matches hold, whether it matches
nothing, and a form of it that does not look at a long run of characters again and again.

Only patterns that Python's own parser reads too are analysed; others are used as they are.
"""

from __future__ import annotations

import re
from re import _constants as ops  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

#: A pattern that starts with a repeated class and goes on with one plain character.
_LEADING = re.compile(r"^(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\]|\\[dws])\+(?P<next>\\[^A-Za-z0-9]|[^\\.\[\](){}*+?|^$])(?![*?{])")


def may_be_empty(pattern: str) -> bool:
    try:
        return _parser.parse(pattern).getwidth()[0] == 0
    except (re.error, RecursionError, OverflowError):
        return True


def linear(pattern: str) -> str:
    """A pattern of the same matches that tries a run of its leading class from the run's start only, and takes it whole.

    Of ``[a-z]+@``, every start within a run of letters fails or succeeds with the character after the run: one is
    tried where the run begins, or where the match before ended.  A run of n characters so costs n steps, not n squared.
    """
    found = _LEADING.match(pattern)
    if not found:
        return pattern
    own, after = found["set"], found["next"]
    try:
        if re.fullmatch(own, after[-1], re.ASCII | re.IGNORECASE):
            return pattern
    except re.error:
        return pattern
    return rf"(?:(?<!{own})|\G){own}++{pattern[found.start('next'):]}"


def _ascii(code: int) -> str | None:
    # Beyond ASCII, engines fold case in different ways.
    return chr(code).lower() if code < 128 else None


def _best(choices: list[frozenset[str]]) -> frozenset[str]:
    return max(choices, key=lambda c: (min(map(len, c)), -len(c)), default=frozenset())


def _of(items) -> frozenset[str]:
    """The best set of literals of which every match of a sequence holds one; empty if there is none."""
    choices, run = [], ""
    for op, arg in [*items, (None, None)]:
        letter = _ascii(arg) if op is ops.LITERAL else None
        if letter:
            run += letter
            continue
        if run:
            choices.append(frozenset([run]))
            run = ""
        if op is ops.SUBPATTERN:
            choices.append(_of(arg[3]))
        elif op is ops.ATOMIC_GROUP:
            choices.append(_of(arg))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and arg[0] > 0:
            choices.append(_of(arg[2]))
        elif op is ops.BRANCH:
            each = [_of(branch) for branch in arg[1]]
            if all(each):
                choices.append(frozenset().union(*each))
    return _best([c for c in choices if c])


def required(pattern: str, shortest: int = 1, most: int = 64) -> frozenset[str]:
    """Literals in lower case of which every match holds at least one, whatever its case; empty if none are known."""
    try:
        found = _of(_parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return frozenset()
    return found if found and len(found) <= most and min(map(len, found)) >= shortest else frozenset()


def any_of(literals: set[str]) -> str:
    """A pattern with one empty match at each place where a literal stands, the longest there as group 1, sharing first letters."""

    def tree(words: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in words:
            if w:
                heads.setdefault(w[0], []).append(w[1:])
        branches = [re.escape(c) + tree(rest) for c, rest in sorted(heads.items())]
        if not branches:
            return ""
        # Longer ones first: what ends here is tried after what goes on.
        return f"(?:{'|'.join(branches)}){'?' if '' in words else ''}"

    return f"(?i)(?=({tree(sorted(literals))}))"
