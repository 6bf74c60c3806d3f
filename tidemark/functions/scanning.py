"""Rewriting text by ordered alternatives in one pass: where several could begin, the first one that matches acts.

Rules are data. ``scan`` applies them as a column expression: one regular expression replacement marks what each alternative
took, and its pieces are put together again, so a text goes through the JVM once, whatever the number of rules. ``scan_text`` applies
the same rules to one value, for texts inside other formats (scripts in pages). Both agree on every text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import let

#: Characters that no text holds by the standard; what has them anyway is told apart by the third.
_PIECE, _GROUP, _OWN = "\ufdd0", "\ufdd1", "\ufdd2"


#: What stands for the match in what a rule puts there.
IT = "\x00"


@dataclass(frozen=True)
class Rule:
    """What ``core`` matches, between ``before`` and ``after`` (kept as they are), becomes ``to``, in which IT stands for it.

    With ``link`` it becomes a link into the archive, of that modifier or (empty) the page's own. Expressions hold no capturing groups,
    are read line by line (^ and $), and mean the same in Python and Java; a core matches one character at least.
    """

    core: str
    to: str = IT
    before: str = ""
    after: str = ""
    link: str | None = None

    @property
    def expression(self) -> str:
        return f"({self.before})({self.core})({self.after})"


@functools.lru_cache(64)
def _compiled(rules: tuple[Rule, ...]) -> re.Pattern[str]:
    return re.compile("|".join(r.expression for r in rules), re.M)


def scan_text(text: str, rules: Sequence[Rule], link: Callable[[str, str], str]) -> str:
    """One value rewritten; ``link`` makes a link of a URL and a modifier."""

    def one(m: re.Match[str]) -> str:
        k = (m.lastindex - 1) // 3
        before, core, after = m[3 * k + 1], m[3 * k + 2], m[3 * k + 3]
        return before + (rules[k].to.replace(IT, core) if rules[k].link is None else link(core, rules[k].link)) + after

    return _compiled(tuple(rules)).sub(one, text) if rules else text


def scan(text: Column, rules: Sequence[Rule], link: Callable[[Column, str], Column]) -> Column:
    """A column rewritten; ``link`` makes a link of a URL column and a modifier. Null stays null."""
    if not rules:
        return text
    expression = "(?mU)" + "|".join(r.expression for r in rules)
    marked = _PIECE + _GROUP.join(f"${k + 1}" for k in range(3 * len(rules))) + _PIECE

    def put_together(groups: Column) -> Column:
        out = F.lit("")
        for k in reversed(range(len(rules))):
            core, r = groups[3 * k + 1], rules[k]
            if r.link is not None:
                new = link(core, r.link)
            else:
                new = F.array_join(F.array(*(x for n, s in enumerate(r.to.split(IT)) for x in ([core] if n else []) + [F.lit(s)])), "")
            out = F.when(core != "", F.concat(groups[3 * k], new, groups[3 * k + 2])).otherwise(out)
        return out

    def pieces(plain: Column) -> Column:
        parts = F.split(F.regexp_replace(plain, expression, marked), _PIECE, -1)
        return F.array_join(F.transform(parts, lambda x, n: F.when(n % 2 == 0, x).otherwise(let(F.split(x, _GROUP, -1), put_together))), "")

    def escaped(t: Column) -> Column:
        # a text that holds the marks themselves has them replaced, and put back at the end
        odd = t.rlike(f"[{_PIECE}{_GROUP}{_OWN}]")
        away, back = t, pieces(let(t, lambda x: functools.reduce(lambda c, m: F.replace(c, F.lit(m[0]), F.lit(m[1])), _ESCAPES, x)))
        for mark, stand_in in reversed(_ESCAPES):
            back = F.replace(back, F.lit(stand_in), F.lit(mark))
        return F.when(odd, back).when(away.rlike(expression), pieces(away)).otherwise(away)

    return let(text, escaped)


#: Stand-ins end in characters that are no part of a word either, so that expressions see the same borders.
_ESCAPES = ((_OWN, _OWN + "\ufdd5"), (_PIECE, _OWN + "\ufdd3"), (_GROUP, _OWN + "\ufdd4"))
