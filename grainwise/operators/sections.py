"""Audits of a whole query: set-operation branches and CTE bodies, one section each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from grainwise.errors import AuditError
from grainwise.operators.audit import MAIN, SECTIONS, AuditResult, audit
from grainwise.plans.spec import JoinChain

Body = JoinChain | Sequence[JoinChain]


def labelled(body: Body, label: str) -> list[tuple[str, JoinChain]]:
    """The branches of a set operation, numbered; a single SELECT keeps the label."""
    chains = [body] if isinstance(body, JoinChain) else list(body)
    if len(chains) == 1:
        return [(label, chains[0])]
    # The wording of branch labels.
    return [(f"{label} - UNION branch {n} of {len(chains)}", c) for n, c in enumerate(chains, 1)]


@dataclass
class QueryResult:
    """Results per section, in order; a section that failed holds its error instead."""

    spark: SparkSession
    parts: list[tuple[str, AuditResult | None, str | None]]

    @property
    def analyzed(self) -> list[AuditResult]:
        return [r for _, r, _ in self.parts if r is not None]

    def __getitem__(self, section: str) -> AuditResult:
        return next(r for label, r, _ in self.parts if label == section and r is not None)

    def _all(self, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(r, name) for r in self.analyzed])

    @property
    def steps(self) -> DataFrame:
        return self._all("steps")

    @property
    def key_stats(self) -> DataFrame:
        return self._all("key_stats")

    @property
    def top_keys(self) -> DataFrame:
        return self._all("top_keys")

    @property
    def fixes(self) -> DataFrame:
        return self._all("fixes")

    @property
    def agg_risks(self) -> DataFrame:
        return self._all("agg_risks")

    @property
    def facts(self) -> DataFrame:
        return self._all("facts")

    @property
    def sections(self) -> DataFrame:
        failed = [(label, None, None, None, None, None, error)
                  for label, r, error in self.parts if r is None]
        frames = [r.sections for r in self.analyzed]
        if failed:
            frames.append(self.spark.createDataFrame(failed, SECTIONS))
        return reduce(DataFrame.unionByName, frames)


def audit_query(main: Body, ctes: Mapping[str, Body] | None = None, *, include_ctes: bool = True,
                **options) -> QueryResult:
    """Audits every branch of ``main`` and, if wanted, every CTE body that has joins.

    A CTE that a branch reads is simply a DataFrame among that branch's inputs.
    Raises :class:`AuditError` if no section could be measured.
    """
    todo = labelled(main, MAIN)
    if include_ctes:
        todo += [(label, chain) for name, body in (ctes or {}).items()
                 for label, chain in labelled(body, f"CTE {name}") if chain.joins]
    return _run(todo, options)


def audit_sections(chains: Mapping[str, JoinChain], **options) -> QueryResult:
    """Audits chains under labels of the caller's choice."""
    return _run(list(chains.items()), options)


def _run(todo: list[tuple[str, JoinChain]], options: dict) -> QueryResult:
    """One part per section.  It takes one measured section to make a result; without any,
    the first section that has joins tells why."""
    parts: list[tuple[str, AuditResult | None, str | None]] = []
    failure = "No joins in the query or its CTEs."
    for label, chain in reversed(todo):
        try:
            parts.insert(0, (label, audit(chain, label, **options), None))
        except AuditError as e:
            parts.insert(0, (label, None, str(e)))
            failure = str(e) if chain.joins else failure
    if all(result is None for _, result, _ in parts):
        raise AuditError(failure)
    return QueryResult(todo[0][1].driving.sparkSession, parts)
