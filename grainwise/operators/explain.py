"""Why a join did or did not multiply rows: a cause code and a sentence."""

from __future__ import annotations

from grainwise.plans.forest import Counts
from grainwise.plans.spec import BoundJoin

CROSS = "cross"
NATURAL = "natural"
NOT_EQUALITY = "not_equality"
UNIQUE = "unique"
NO_GROWTH = "repeats_without_growth"
OTHER_CONDITION = "unique_but_grew"
ONE_TO_MANY = "one_to_many"
MANY_TO_MANY = "many_to_many"
COMPOUNDED = "compounded"


def cause_of(b: BoundJoin, c: Counts, fanout: bool, cardinality: str, earlier: int | None) -> str:
    """The cause code; ``earlier`` is the first join before this one that fans out."""
    if b.how == "cross":
        return CROSS
    if b.natural:
        return NATURAL
    if not b.profiled:
        return NOT_EQUALITY
    unique = c.max_dup_non_null <= 1
    if not fanout:
        return UNIQUE if unique else NO_GROWTH
    if unique:
        return OTHER_CONDITION
    if cardinality != "many-to-many":
        return ONE_TO_MANY
    return COMPOUNDED if earlier is not None else MANY_TO_MANY


def explanation(cause: str, b: BoundJoin, c: Counts, factor: float | None, earlier: int | None,
                exact_dup_rows: int | None) -> str:
    table, keys = b.join.source, ", ".join(b.right)
    grew = f"{c.rows_before:,} to {c.rows_after:,} rows"
    if cause == CROSS:
        return f"Nothing links `{b.join.alias}` to the rows so far: all combinations are formed ({grew})."
    if cause == NATURAL:
        return f"`{table}` is matched on every shared column name; its keys are not profiled ({grew})."
    if cause == NOT_EQUALITY:
        return f"The condition compares no pair of columns for equality, so only rows are counted ({grew})."
    if cause == UNIQUE:
        return f"Every value of ({keys}) occurs once in `{table}`: a row finds one match at most."
    if cause == NO_GROWTH:
        return f"`{table}` holds repeated values of ({keys}), but the result did not grow ({grew})."
    if cause == OTHER_CONDITION:
        return (f"Every value of ({keys}) occurs once in `{table}`, still the result grew ({grew}); "
                "the remaining conditions or unmatched rows add them.")
    text = (f"`{table}` repeats ({keys}): {c.n_rows:,} rows for {c.n_keys:,} values, {c.dup_keys:,} of them "
            f"repeated, up to {c.max_dup_non_null:,} rows for one value. Each row is copied per match: "
            f"{grew}{'' if factor is None else f', {factor:.2f} times'}.")
    if cause == MANY_TO_MANY:
        text += (f" The rows so far repeat the key as well (up to {c.left_max_dup_non_null:,}), so both "
                 "sides multiply; the key is probably coarser than what one row stands for.")
    if cause == COMPOUNDED:
        text += (f" The rows so far repeat the key too (up to {c.left_max_dup_non_null:,}) since join "
                 f"{earlier} already multiplied them. Repair join {earlier} first, or aggregate each "
                 "repeating table on its own.")
    if exact_dup_rows:
        text += f" {exact_dup_rows:,} rows of `{table}` are complete copies of another row."
    if c.null_rows:
        text += f" {c.null_rows:,} rows have a NULL in the key and match nothing."
    return text
