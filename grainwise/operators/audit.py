"""The audit of one chain: :func:`audit` returns an :class:`AuditResult`."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.errors import AuditError
from grainwise.operators import explain, profile
from grainwise.operators.fixes import TOLERANCE, Fix, build_fixes, first_line
from grainwise.operators.impact import Risk, measure_columns, risks_of
from grainwise.operators.rewrites import rewrite_chain
from grainwise.operators.samples import worst_key_rows
from grainwise.plans.forest import Counts, Forest
from grainwise.plans.spec import BoundJoin, JoinChain, quoted
from grainwise.plans.storage import Shelf
from grainwise.plans.weights import LONG_MAX

MAIN = "Main query"


@dataclass
class Step:
    """One measured join; ``index`` counts from 0."""

    index: int
    bound: BoundJoin
    counts: Counts
    factor: float | None
    fanout: bool
    cardinality: str = "unknown"
    cause: str = ""
    explanation: str = ""
    exact_dup_rows: int | None = None
    fixes: list[Fix] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def rows_before(self) -> int:
        return self.counts.rows_before

    @property
    def rows_after(self) -> int:
        return self.counts.rows_after


def audit(chain: JoinChain, section: str = MAIN, *, fixes: bool = True, exact_duplicates: bool = True,
          hot_floor: int = 10_000) -> AuditResult:
    """Measures every join of ``chain`` on the full tables.

    Each join costs one aggregate over the key counts of both sides, whose single row
    comes back to the driver and decides what the next join needs.  ``fixes`` and
    ``exact_duplicates`` switch off the extra passes; ``hot_floor`` is the number of
    tuples per key below which a join is never salted.
    """
    try:
        bound = chain.bind()
        if not bound.joins:
            raise AuditError("No joins in this section, nothing to measure.")
        carried, measures = measure_columns(bound)
        spark = chain.driving.sparkSession
        shelf = Shelf(spark)
        try:
            forest = Forest(bound, shelf, measures, hot_floor)
            steps: list[Step] = []
            for b in bound.joins:
                steps.append(_step(chain, forest, b, steps, fixes, exact_duplicates))
                if b.index + 1 < len(bound.joins):
                    forest.advance(b.index, steps[-1].counts)
            base, joined = forest.base, steps[-1].counts.measures
            if measures and joined is None and any(s.fanout for s in steps):
                forest.advance(len(steps) - 1, steps[-1].counts)
                joined = forest.totals()[1]
        finally:
            shelf.close()
    except AnalysisException as e:
        raise AuditError(first_line(e)) from e
    return AuditResult(spark, chain, section, steps, risks_of(bound, steps, base, joined, carried))


def _step(chain: JoinChain, forest: Forest, b: BoundJoin, earlier: list[Step], fixes: bool,
          exact_duplicates: bool) -> Step:
    c = forest.measure(b.index)
    factor = c.rows_after / c.rows_before if c.rows_before else None
    fanout = (b.how == "cross" and c.rows_before > 0) or (factor is not None and factor > TOLERANCE)
    step = Step(b.index, b, c, factor, fanout)
    if b.profiled:
        left_unique = c.left_max_dup_non_null <= 1
        step.cardinality = ("one" if left_unique else "many") + "-to-" + (
            "one" if c.max_dup_non_null <= 1 else "many")
        if exact_duplicates:
            try:
                step.exact_dup_rows = int(profile.exact_duplicates(b.join.df).first()[0])
            except AnalysisException as e:
                step.warnings.append(f"Exact copies could not be counted: {first_line(e)}")
    prior = next((s.index + 1 for s in earlier if s.fanout), None)
    step.cause = explain.cause_of(b, c, fanout, step.cardinality, prior)
    step.explanation = explain.explanation(step.cause, b, c, factor, prior, step.exact_dup_rows)
    if fixes and fanout and b.profiled and c.max_dup_non_null > 1:
        try:
            step.fixes = build_fixes(chain, b.index, c, forest, step.exact_dup_rows, step.warnings)
        except (AuditError, AnalysisException) as e:
            step.warnings.append(f"Rewrites could not be built: {first_line(e)}")
    return step


def _bigints(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows as a frame; a bigint column holding a larger count becomes decimal(38,0)."""
    schema = T.StructType.fromDDL(ddl)
    fields = []
    for n, f in enumerate(schema.fields):
        wide = isinstance(f.dataType, T.LongType) and any(
            r[n] is not None and r[n] > LONG_MAX for r in rows)
        fields.append(T.StructField(f.name, T.StringType() if wide else f.dataType))
    rows = [tuple(str(v) if isinstance(f.dataType, T.StringType) and isinstance(v, int) else v
                  for v, f in zip(r, fields)) for r in rows]
    df = spark.createDataFrame(rows, T.StructType(fields))
    for f, want in zip(fields, schema.fields):
        if f.dataType != want.dataType:
            df = df.withColumn(f.name, F.col(f.name).cast("decimal(38,0)"))
    return df


STEPS = ("section string, step int, join_type string, source string, alias string, on_sql string, "
         "rows_before bigint, rows_after bigint, factor double, fanout boolean, equi boolean, "
         "cardinality string, left_keys array<string>, right_keys array<string>, left_max_dup bigint, "
         "cause string, explanation string, warnings array<string>")
KEY_STATS = ("section string, step int, n_rows bigint, n_keys bigint, max_dup bigint, "
             "max_dup_non_null bigint, dup_keys bigint, null_rows bigint, exact_dup_rows bigint")
FIXES = ("section string, step int, rank int, kind string, title string, why string, sql string, "
         "verified_rows bigint, verified_factor double, restores_grain boolean")
RISKS = ("section string, expression string, kind string, columns array<string>, "
         "affected_joins array<int>, base_value double, joined_value double, inflation_pct double, "
         "note string, base_exact string, joined_exact string")
SECTIONS = ("section string, joins int, fanouts int, driving_rows bigint, final_rows bigint, "
            "overall_factor double, error string")
TOP_KEYS = "section string, step int, key map<string,string>, rows_per_key bigint"
FACTS = "section string, json string"


@dataclass
class AuditResult:
    """What was measured, each part as a DataFrame."""

    spark: SparkSession
    chain: JoinChain
    section: str
    step_list: list[Step]
    risk_list: list[Risk]

    @property
    def driving_rows(self) -> int:
        return self.step_list[0].rows_before

    @property
    def final_rows(self) -> int:
        return self.step_list[-1].rows_after

    @property
    def overall_factor(self) -> float | None:
        return self.final_rows / self.driving_rows if self.driving_rows else None

    @property
    def fanout_steps(self) -> list[Step]:
        return [s for s in self.step_list if s.fanout]

    @property
    def steps(self) -> DataFrame:
        return _bigints(self.spark, [
            (self.section, s.index + 1, s.bound.join_type, s.bound.join.source, s.bound.join.alias,
             s.bound.on_sql, s.rows_before, s.rows_after, s.factor, s.fanout, s.bound.equi, s.cardinality,
             s.bound.left_names, s.bound.right_names,
             s.counts.left_max_dup if s.bound.profiled else None, s.cause, s.explanation, s.warnings)
            for s in self.step_list], STEPS)

    @property
    def key_stats(self) -> DataFrame:
        """One row per join with profiled keys."""
        return _bigints(self.spark, [
            (self.section, s.index + 1, s.counts.n_rows, s.counts.n_keys, s.counts.max_dup,
             s.counts.max_dup_non_null, s.counts.dup_keys, s.counts.null_rows, s.exact_dup_rows)
            for s in self.step_list if s.bound.profiled], KEY_STATS)

    @property
    def top_keys(self) -> DataFrame:
        """The ten most repeated right keys of every profiled join, computed on demand."""
        frames = []
        for s in self.step_list:
            if s.bound.profiled:
                keys = s.bound.right_names
                names = F.array(*[F.lit(k) for k in keys])
                values = F.array(*[quoted(k).cast("string") for k in keys])
                frames.append(profile.top_keys(s.bound.join.df, keys).select(
                    F.lit(self.section).alias("section"), F.lit(s.index + 1).alias("step"),
                    F.map_from_arrays(names, values).alias("key"), "rows_per_key"))
        if not frames:
            return self.spark.createDataFrame([], TOP_KEYS)
        return reduce(DataFrame.unionByName, frames)

    def worst_key_rows(self, step: int, limit: int | None = 8) -> DataFrame | None:
        """Joined rows of the most repeated non-NULL key of join ``step`` (from 1)."""
        return worst_key_rows(self.chain, step - 1, limit)

    def rewrite(self, step: int, kind: str, column: str | None = None) -> DataFrame:
        """The joined rows with join ``step`` (from 1) rewritten."""
        return rewrite_chain(self.chain, step - 1, kind, column).to_df()

    @property
    def fixes(self) -> DataFrame:
        return _bigints(self.spark, [
            (self.section, s.index + 1, n + 1, f.kind, f.title, f.why, f.sql, f.verified_rows,
             f.factor(s.rows_before), f.restores(s.rows_before))
            for s in self.step_list for n, f in enumerate(s.fixes)], FIXES)

    @property
    def agg_risks(self) -> DataFrame:
        return self.spark.createDataFrame([
            (self.section, r.expression, r.kind, r.columns, r.affected_joins, r.base_value,
             r.joined_value, r.inflation_pct, r.note, r.base_exact, r.joined_exact) for r in self.risk_list], RISKS)

    @property
    def sections(self) -> DataFrame:
        return _bigints(self.spark, [
            (self.section, len(self.step_list), len(self.fanout_steps), self.driving_rows,
             self.final_rows, self.overall_factor, None)], SECTIONS)

    @property
    def facts(self) -> DataFrame:
        """One JSON document of computed facts; it holds no table rows."""
        return self.spark.createDataFrame([(self.section, json.dumps(self.facts_dict()))], FACTS)

    def facts_dict(self) -> dict:
        # The field names of the facts document.
        def rounded(x: float | None, digits: int) -> float | None:
            return None if x is None else round(x, digits)

        joins = []
        for s in self.step_list:
            first = s.fixes[0] if s.fixes else None
            joins.append({
                "step": s.index + 1, "type": s.bound.join_type, "table": s.bound.join.source,
                "rows_before": s.rows_before, "rows_after": s.rows_after, "factor": rounded(s.factor, 3),
                "cardinality": s.cardinality, "fanout": s.fanout, "join_keys": s.bound.right_names,
                "max_repeats_of_a_key": s.counts.max_dup if s.bound.profiled else None,
                "top_fix": first.title if first else None,
                "top_fix_verified_rows": first.verified_rows if first else None})
        return {
            "driving_source": self.chain.source, "driving_rows": self.driving_rows,
            "final_rows": self.final_rows, "overall_factor": rounded(self.overall_factor, 3),
            "joins": joins,
            "aggregates_at_risk": [
                {"expression": r.expression, "kind": r.kind,
                 "inflation_pct": rounded(r.inflation_pct, 1), "note": r.note} for r in self.risk_list]}
