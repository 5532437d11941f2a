"""Declarative input of an audit: a driving table, its joins and what is read.

A :class:`JoinChain` states the join keys instead of SQL text.  It carries no
filter: row counts are measured before filtering, so a filter that belongs to
one input is applied to that input's DataFrame by the caller.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.errors import AuditError

_HOW = {
    "inner": "inner",
    "left": "left", "leftouter": "left",
    "right": "right", "rightouter": "right",
    "full": "full", "outer": "full", "fullouter": "full",
    "cross": "cross",
    "semi": "semi", "leftsemi": "semi",
    "anti": "anti", "leftanti": "anti",
}


@dataclass(frozen=True)
class Ref:
    """One column of one input, by alias."""

    alias: str
    column: str

    def __str__(self) -> str:
        return f"{self.alias}.{self.column}"


@dataclass(frozen=True)
class Join:
    """One joined input.

    ``on`` holds ``("a.left_col", "right_col")`` pairs, ``using`` shared column
    names, ``residual`` any further condition as Spark SQL over ``alias.column``.
    ``order_col`` overrides the column that decides which row "keep one row per
    key" keeps.
    """

    df: DataFrame
    alias: str
    how: str = "inner"
    on: Sequence[tuple[str, str]] = ()
    using: Sequence[str] = ()
    natural: bool = False
    residual: str | None = None
    name: str | None = None
    order_col: str | None = None

    @property
    def source(self) -> str:
        return _source_label(self.name, self.alias)


@dataclass(frozen=True)
class Agg:
    """One aggregate of the select list; ``expr`` None is ``COUNT(*)``.

    ``columns`` defaults to the ``alias.column`` names found in ``expr``; a name
    given without alias counts as unqualified.
    """

    fn: str
    expr: str | None = None
    distinct: bool = False
    columns: Sequence[str] | None = None

    @property
    def kind(self) -> str:
        return self.fn.lower()

    @property
    def text(self) -> str:
        inner = self.expr if self.expr is not None else "*"
        return f"{self.fn.upper()}({'DISTINCT ' if self.distinct else ''}{inner})"


@dataclass(frozen=True)
class JoinChain:
    """Driving table, joins in order, and the columns the query reads.

    ``select`` lists expressions over ``alias.column`` (``"*"`` and ``"a.*"`` read
    everything), ``aggs`` the aggregates, ``uses`` columns read elsewhere (filter,
    grouping).  With neither ``select`` nor ``aggs`` the chain reads everything.
    """

    driving: DataFrame
    alias: str
    joins: Sequence[Join] = ()
    select: Sequence[str] | None = None
    aggs: Sequence[Agg] = ()
    uses: Sequence[str] = ()
    name: str | None = None
    _bound: list = field(default_factory=list, compare=False, repr=False)

    @property
    def source(self) -> str:
        return _source_label(self.name, self.alias)

    def with_joins(self, joins: Sequence[Join]) -> JoinChain:
        return replace(self, joins=tuple(joins), _bound=[])

    def prefix(self, k: int) -> JoinChain:
        """The chain cut after its first ``k`` joins."""
        return self.with_joins(self.joins[:k])

    def replace_join(self, i: int, **changes) -> JoinChain:
        joins = list(self.joins)
        joins[i] = replace(joins[i], **changes)
        return self.with_joins(joins)

    def bind(self) -> BoundChain:
        """Resolve every name against the input schemas (no job is run)."""
        if not self._bound:
            self._bound.append(BoundChain(self))
        return self._bound[0]

    def to_df(self, upto: int | None = None) -> DataFrame:
        """The joined rows of the first ``upto`` joins, with unique column names."""
        from grainwise.plans.prefix import joined_rows

        return joined_rows(self, upto)


@dataclass(frozen=True)
class BoundJoin:
    """A join with resolved keys.  ``left`` holds, per key, the candidate columns:
    one for ON, every merged input for USING and NATURAL."""

    index: int
    pos: int
    join: Join
    how: str
    left: tuple[tuple[Ref, ...], ...]
    right: tuple[str, ...]
    residual_left: tuple[Ref, ...]
    residual_right: tuple[str, ...]
    natural: bool
    using: bool

    @property
    def join_type(self) -> str:
        return self.how.upper()

    @property
    def profiled(self) -> bool:
        """NATURAL joins match by name only, so their keys are not profiled."""
        return bool(self.right) and not self.natural

    @property
    def equi(self) -> bool:
        return self.profiled and self.join.residual is None

    @property
    def reads_left(self) -> bool:
        return self.join.residual is not None and bool(self.residual_left)

    @property
    def left_names(self) -> list[str]:
        if not self.profiled:
            return []
        return [r[0].column if self.using else str(r[0]) for r in self.left]

    @property
    def right_names(self) -> list[str]:
        return list(self.right) if self.profiled else []

    @property
    def on_sql(self) -> str:
        if self.using:
            return f"USING ({', '.join(self.right)})"
        if self.natural:
            return ""
        parts = [f"{r[0]} = {self.join.alias}.{c}" for r, c in zip(self.left, self.right)]
        if self.join.residual is not None:
            parts.append(f"({self.join.residual})")
        return " AND ".join(parts)


class BoundChain:
    """Names resolved: positions, physical column names, keys, columns still needed."""

    def __init__(self, chain: JoinChain):
        self.chain = chain
        self.inputs: list[tuple[str, DataFrame]] = [(chain.alias, chain.driving)]
        self.inputs += [(j.alias, j.df) for j in chain.joins]
        self.pos: dict[str, int] = {}
        for n, (alias, _) in enumerate(self.inputs):
            if alias.lower() in self.pos:
                raise AuditError(f"Alias {alias!r} is used twice.")
            self.pos[alias.lower()] = n
        self.columns = [list(df.columns) for _, df in self.inputs]
        self._lookup = [{c.lower(): c for c in cols} for cols in self.columns]
        self._merged: dict[str, set[Ref]] = {}
        self._hidden: set[int] = set()  # semi and anti sides add no columns
        self.joins: list[BoundJoin] = []
        for i, j in enumerate(chain.joins):
            self.joins.append(self._bind(i, j))

    # -- names -----------------------------------------------------------------
    def ref(self, text: str, before: int | None = None) -> Ref:
        alias, _, column = text.replace("`", "").partition(".")
        pos = self.pos.get(alias.lower())
        if not column or pos is None:
            raise AuditError(f"Column {text!r} must be written alias.column with a known alias.")
        if before is not None and (pos >= before or pos in self._hidden):
            raise AuditError(f"Column {text!r} is not visible to the inputs joined so far.")
        found = self._lookup[pos].get(column.lower())
        if found is None:
            raise AuditError(f"Input {alias!r} has no column {column!r}.")
        return Ref(self.inputs[pos][0], found)

    def has(self, pos: int, column: str) -> str | None:
        return self._lookup[pos].get(column.lower())

    def refs_in(self, text: str) -> list[Ref]:
        """Every known ``alias.column`` that occurs in an expression.

        Only used to keep columns alive, so a false hit (inside a string literal)
        costs a column and never a result.
        """
        out: dict[Ref, None] = {}
        for alias, column in re.findall(r"`?(\w+)`?\s*\.\s*`?(\w+)`?", text):
            pos = self.pos.get(alias.lower())
            if pos is not None and self.has(pos, column):
                out[Ref(self.inputs[pos][0], self.has(pos, column))] = None
        return list(out)

    def physical(self, ref: Ref) -> str:
        """Column name used inside the audit's own frames; unique across inputs."""
        return f"t{self.pos[ref.alias.lower()]}__{ref.column}"

    # -- binding ---------------------------------------------------------------
    def _bind(self, i: int, j: Join) -> BoundJoin:
        pos = i + 1
        how = _HOW.get(j.how.lower().replace("_", "").replace(" ", ""))
        if how is None:
            raise AuditError(f"Unknown join type {j.how!r}.")
        if sum(map(bool, (j.on, j.using, j.natural))) > 1:
            raise AuditError(f"Join {j.alias!r}: give one of on, using, natural.")
        if not (j.on or j.using or j.natural or j.residual):
            how = "cross"
        elif how == "cross":
            raise AuditError(f"Join {j.alias!r}: a cross join takes no condition.")
        left, right = [], []
        if j.on:
            for l_text, r_text in j.on:
                left.append((self.ref(l_text, before=pos),))
                right.append(self._own(pos, r_text))
        else:
            for name in (j.using or (self._shared(pos) if j.natural else ())):
                left.append(self._owners(pos, name))
                right.append(self._own(pos, name))
                self._merged[name.lower()] = {*left[-1], Ref(j.alias, right[-1])}
        if how in ("semi", "anti"):
            self._hidden.add(pos)
        res_left: list[Ref] = []
        res_right: list[str] = []
        if j.residual is not None:
            for r in self.refs_in(j.residual):
                p = self.pos[r.alias.lower()]
                if p > pos:
                    raise AuditError(f"Join {j.alias!r}: residual reads {r}, which is not joined yet.")
                if p == pos:
                    res_right.append(r.column)
                else:
                    res_left.append(self.ref(str(r), before=pos))
        return BoundJoin(i, pos, j, how, tuple(left), tuple(right), tuple(res_left),
                         tuple(res_right), j.natural, bool(j.using))

    def _own(self, pos: int, text: str) -> str:
        alias, dot, column = text.replace("`", "").rpartition(".")
        if dot and alias.lower() != self.inputs[pos][0].lower():
            raise AuditError(f"Right key {text!r} does not belong to {self.inputs[pos][0]!r}.")
        found = self.has(pos, column)
        if found is None:
            raise AuditError(f"Input {self.inputs[pos][0]!r} has no column {column!r}.")
        return found

    def _shared(self, pos: int) -> list[str]:
        seen = {c.lower() for p in range(pos) if p not in self._hidden for c in self.columns[p]}
        return [c for c in self.columns[pos] if c.lower() in seen]

    def _owners(self, pos: int, name: str) -> tuple[Ref, ...]:
        """The inputs so far that hold a USING column; more than one only if merged before."""
        owners = tuple(Ref(self.inputs[p][0], self.has(p, name))
                       for p in range(pos) if p not in self._hidden and self.has(p, name))
        if not owners:
            raise AuditError(f"USING column {name!r} is in no input joined so far.")
        if len(owners) > 1 and not set(owners) <= self._merged.get(name.lower(), set()):
            raise AuditError(f"USING column {name!r} is ambiguous among the inputs joined so far.")
        return owners

    # -- what is read ----------------------------------------------------------
    def needed_after(self, i: int, alive: set[int], mixed: bool = False) -> set[Ref]:
        """Columns that joins after join ``i`` read, in a part of the result where only
        the inputs at positions ``alive`` are not NULL throughout.  In a ``mixed`` part
        that differs by row, so every candidate of a merged column stays."""
        out: set[Ref] = set()
        for b in self.joins[i + 1:]:
            for candidates in b.left:
                live = [r for r in candidates if self.pos[r.alias.lower()] in alive]
                out.update(live if mixed else live[:1])
            out.update(r for r in b.residual_left if self.pos[r.alias.lower()] in alive)
        return out

    def used_columns(self, i: int) -> tuple[list[str], bool]:
        """Columns of joined input ``i`` read outside its own condition, and whether
        everything is read through a star."""
        pos = i + 1
        chain, alias = self.chain, self.inputs[pos][0]
        select = chain.select if chain.select is not None else (() if chain.aggs else ("*",))
        star = any(s.strip() == "*" or s.replace("`", "").strip().lower() == f"{alias.lower()}.*"
                   for s in select)
        refs: list[Ref] = []
        for text in [*select, *chain.uses, *(a.expr or "" for a in chain.aggs)]:
            refs += self.refs_in(text)
        for a in chain.aggs:
            refs += [r for c in (a.columns or ()) for r in self.refs_in(c)]
        for b in self.joins:
            if b.index != i:
                refs += [r for candidates in b.left for r in candidates]
                refs += list(b.residual_left)
        used = {r.column for r in refs if self.pos[r.alias.lower()] == pos}
        return sorted(used), star

    def agg_columns(self, agg: Agg) -> list[str]:
        """Columns of an aggregate, as ``alias.column`` or bare names if unqualified."""
        if agg.columns is not None:
            return list(agg.columns)
        if agg.expr is None:
            return []
        found = [str(r) for r in self.refs_in(agg.expr)]
        return found or [agg.expr]

    # -- frames ----------------------------------------------------------------
    def frame(self, pos: int, columns: Sequence[str]) -> DataFrame:
        """Input ``pos`` cut to ``columns``, under their physical names."""
        alias, df = self.inputs[pos]
        return df.select(*[quoted(c).alias(self.physical(Ref(alias, c))) for c in columns])

    def as_structs(self, df: DataFrame, refs: Sequence[Ref]) -> DataFrame:
        """Adds one struct column per alias so that ``alias.column`` text resolves."""
        by_alias: dict[str, list[Ref]] = {}
        for r in refs:
            by_alias.setdefault(r.alias, []).append(r)
        for alias, rs in by_alias.items():
            df = df.withColumn(alias, F.struct(*[quoted(self.physical(r)).alias(r.column) for r in rs]))
        return df


def quoted(name: str):
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _source_label(name: str | None, alias: str) -> str:
    return alias if name is None or name == alias else f"{name} {alias}"
