"""Path filters: hidden names, built-in and user globs, per-root ignore files (ops 8-11, 14).

A walker that prunes during traversal never enters an excluded directory. Over
a table the same effect is one per-row predicate: a node is kept when neither
it nor any ancestor prefix is excluded (strict prefixes are always directories).
For built-in and user globs this is evaluated on each row with no join and no
shuffle; per-root rules (``.mktreeignore``) need an equi-join on ``root``.

Glob semantics (one pattern): a trailing ``/`` restricts it to directories;
the pattern must match the whole relative path, and a pattern without an inner
``/`` may also match any single component. ``*`` and ``?`` cross ``/``,
``[...]`` / ``[!...]`` are classes, ``**`` is valid only as a whole component,
matching is case-sensitive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

_META = set("\\.^$|?*+()[]{}")


class GlobError(ValueError):
    pass


def _escape(ch: str) -> str:
    return "\\" + ch if ch in _META else ch


def _class_char(ch: str) -> str:
    return "\\" + ch if ch in "\\]^-[" else ch


def glob_to_regex(pattern: str) -> str:
    """Translate one glob into an anchored regex valid in both Java and RE2."""
    out: list[str] = []
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            stars = j - i
            if stars > 2:
                raise GlobError(f"Invalid exclusion pattern: {pattern} (more than two consecutive '*')")
            if stars == 2:
                at_start = i == 0 or pattern[i - 1] == "/"
                at_end = j == n or pattern[j] == "/"
                if not (at_start and at_end):
                    raise GlobError(f"Invalid exclusion pattern: {pattern} ('**' must be a whole component)")
                if j < n:  # '**/' : zero or more directories
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out.append(".*")
            else:
                out.append(".*")
            i = j
        elif ch == "?":
            out.append(".")
            i += 1
        elif ch == "[":
            j = i + 1
            negated = j < n and pattern[j] == "!"
            if negated:
                j += 1
            items: list[str] = []
            first = True
            closed = False
            while j < n:
                c = pattern[j]
                if c == "]" and not first:
                    closed = True
                    break
                if j + 2 < n and pattern[j + 1] == "-" and pattern[j + 2] != "]":
                    lo, hi = c, pattern[j + 2]
                    if lo > hi:
                        raise GlobError(f"Invalid exclusion pattern: {pattern} (bad range)")
                    items.append(f"{_class_char(lo)}-{_class_char(hi)}")
                    j += 3
                else:
                    items.append(_class_char(c))
                    j += 1
                first = False
            if not closed or not items:
                raise GlobError(f"Invalid exclusion pattern: {pattern} (unclosed '[')")
            out.append("[" + ("^" if negated else "") + "".join(items) + "]")
            i = j + 1
        else:
            out.append(_escape(ch))
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Glob:
    raw: str  # as written
    text: str  # trailing '/' removed
    dir_only: bool
    regex: str  # anchored-able body
    literal: bool  # no wildcard at all
    has_slash: bool

    @staticmethod
    def parse(raw: str) -> "Glob":
        text = raw.rstrip("/")
        regex = glob_to_regex(text)
        literal = not any(c in text for c in "*?[")
        return Glob(raw, text, raw.endswith("/"), regex, literal, "/" in text)


def _alternation(regexes: list[str]) -> str | None:
    if not regexes:
        return None
    return "(?s)^(?:" + "|".join(regexes) + ")$"


@dataclass
class RuleSet:
    """Compiled glob rules split by how they must be evaluated."""

    globs: list[Glob] = field(default_factory=list)

    @staticmethod
    def of(patterns: list[str]) -> "RuleSet":
        return RuleSet([Glob.parse(p) for p in patterns])

    def __add__(self, other: "RuleSet") -> "RuleSet":
        return RuleSet(self.globs + other.globs)

    def parts(self):
        comp_lit_all = sorted({g.text for g in self.globs if g.literal and not g.has_slash and not g.dir_only})
        comp_lit_dir = sorted({g.text for g in self.globs if g.literal and not g.has_slash and g.dir_only})
        comp_rx_all = [g.regex for g in self.globs if not g.literal and not g.has_slash and not g.dir_only]
        comp_rx_dir = [g.regex for g in self.globs if not g.literal and not g.has_slash and g.dir_only]
        # full relative-path matches: every pattern with a wildcard or an inner '/'
        full_all = [g.regex for g in self.globs if (not g.literal or g.has_slash) and not g.dir_only]
        full_dir = [g.regex for g in self.globs if (not g.literal or g.has_slash) and g.dir_only]
        return (
            comp_lit_all,
            comp_lit_dir,
            _alternation(comp_rx_all),
            _alternation(comp_rx_dir),
            _alternation(full_all),
            _alternation(full_dir),
        )

    def excluded(self, path: Column, is_dir: Column) -> Column:
        """True when the node or any ancestor prefix is excluded by one of the globs."""
        if not self.globs:
            return F.lit(False)
        lit_all, lit_dir, rx_all, rx_dir, full_all, full_dir = self.parts()
        n = F.size(path)

        def comp_all(c):
            conds = []
            if lit_all:
                conds.append(c.isin(lit_all))
            if rx_all:
                conds.append(c.rlike(rx_all))
            return _or(conds)

        def comp_dir(c):
            conds = []
            if lit_dir:
                conds.append(c.isin(lit_dir))
            if rx_dir:
                conds.append(c.rlike(rx_dir))
            return _or(conds)

        terms = []
        if lit_all or rx_all:
            terms.append(F.exists(path, comp_all))
        if lit_dir or rx_dir:
            terms.append(F.exists(F.slice(path, 1, F.greatest(n - 1, F.lit(0))), comp_dir))
            terms.append(is_dir & comp_dir(F.element_at(path, -1)))
        if full_all or full_dir:

            def prefix_hit(k):
                joined = F.array_join(F.slice(path, 1, k), "/")
                conds = []
                if full_all:
                    conds.append(joined.rlike(full_all))
                if full_dir:
                    conds.append(((k < n) | is_dir) & joined.rlike(full_dir))
                return _or(conds)

            terms.append(F.exists(F.sequence(F.lit(1), n), prefix_hit))
        return F.coalesce(_or(terms), F.lit(False))


def own_excluded(rules: "RuleSet", path: Column, is_dir: Column) -> Column:
    """Is the node itself (not its ancestors) matched: its name by a component pattern,
    or its whole relative path by any pattern."""
    if not rules.globs:
        return F.lit(False)
    lit_all, lit_dir, rx_all, rx_dir, full_all, full_dir = rules.parts()
    name = F.element_at(path, -1)
    joined = F.array_join(path, "/")
    conds = []
    if lit_all:
        conds.append(name.isin(lit_all))
    if rx_all:
        conds.append(name.rlike(rx_all))
    if full_all:
        conds.append(joined.rlike(full_all))
    dir_conds = []
    if lit_dir:
        dir_conds.append(name.isin(lit_dir))
    if rx_dir:
        dir_conds.append(name.rlike(rx_dir))
    if full_dir:
        dir_conds.append(joined.rlike(full_dir))
    if dir_conds:
        conds.append(is_dir & _or(dir_conds))
    return F.coalesce(_or(conds), F.lit(False))


def _or(conds):
    out = None
    for c in conds:
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)


DEFAULT_RULES = RuleSet.of(K.DEFAULT_EXCLUDES)


def useless_dir_names() -> list[str]:
    """Literal directory-only built-in patterns (op 14)."""
    return [p.rstrip("/") for p in K.DEFAULT_EXCLUDES if p.endswith("/") and "*" not in p]


# ---------------------------------------------------------------------------
# DataFrame operators
# ---------------------------------------------------------------------------


def is_hidden(path: Column) -> Column:
    """Any component starts with '.' (the root itself is not a component)."""
    return F.exists(path, lambda c: c.startswith("."))


def drop_hidden(df: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Op 8: drop nodes with a hidden component unless include_hidden."""
    return df if include_hidden else df.filter(~is_hidden(F.col("path")))


def default_excludes(df: DataFrame, all_: bool = False) -> DataFrame:
    """Op 9: drop nodes under the built-in patterns, unless ``all``."""
    if all_:
        return df
    return df.filter(~DEFAULT_RULES.excluded(F.col("path"), F.col("is_dir")))


def glob_exclude(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Op 10: user globs, additive; active under ``all`` too. Invalid globs fail fast."""
    rules = RuleSet.of(list(patterns))
    return df.filter(~rules.excluded(F.col("path"), F.col("is_dir")))


def is_useless_dir(path: Column) -> Column:
    """Op 14: the last name is one of the literal directory patterns."""
    return F.element_at(path, -1).isin(useless_dir_names())


def keep_predicate(
    path: Column,
    is_dir: Column,
    include_hidden: bool = False,
    all_: bool = False,
    exclude: list[str] | None = None,
) -> Column:
    """Combined keep test of ops 8-10 (one expression, evaluated per row)."""
    from ..session import memo_columns

    if isinstance(path, Column) and isinstance(is_dir, Column):
        key = ("keep", str(path), str(is_dir), include_hidden, all_, tuple(exclude or ()))
        return memo_columns(key, lambda: _keep_predicate(path, is_dir, include_hidden, all_, exclude))
    return _keep_predicate(path, is_dir, include_hidden, all_, exclude)


def _keep_predicate(path, is_dir, include_hidden, all_, exclude):
    rules = RuleSet.of(list(exclude or []))
    if not all_:
        rules = DEFAULT_RULES + rules
    keep = ~rules.excluded(path, is_dir)
    if not (include_hidden or all_):
        keep = keep & ~is_hidden(path)
    return keep
