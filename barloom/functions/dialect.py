"""Expressions in the SQL that Spark and the checking engine share, and the few names that differ.

A feature is written once as text: layers of named columns over bars. Spark runs them as DataFrame projections
(one sort by symbol and time for all windows of a layer), `sql()` gives the same as nested SELECTs.
"""

from __future__ import annotations

import re

#: Names of the same function, here and there.
NAMES = {"PCT(": ("percentile(", "quantile_cont("), "MINBY(": ("min_by(", "arg_min("), "MAXBY(": ("max_by(", "arg_max("), "HALF_EVEN(": ("bround(", "round_even("), "BIG(": ("bigint(", "to_big("), "LIST(": ("collect_list(", "list("), "MILLIS(": ("unix_millis(", "epoch_ms("), "LAST_X ": ("last_value(x, true) ", "last_value(x IGNORE NULLS) "), "UNNEST_SEQ(": ("explode(sequence(", "unnest(generate_series("), "FILT(": ("filter(", "list_filter("), "MAP(": ("transform(", "list_transform("), "LEN(": ("size(", "len("), "STARTS(": ("startswith(", "starts_with("), "ARR(": ("array(", "list_value("), "SORTED(": ("array_sort(", "list_sort("), "ITEM(": ("try_element_at(", "list_extract("), "AMAX(": ("array_max(", "list_max("), "AMIN(": ("array_min(", "list_min("), "FN_VJ ": ("(v, j) -> ", "lambda v, j: "), "FN_V ": ("v -> ", "lambda v: "), "MIDNIGHT(": ("date_trunc('day', ", "date_trunc('day', "), "OF_MS(": ("timestamp_millis(", "make_timestamp_ms(")}


#: Forms whose arguments stand in other places: ASUM[list], the sum of a list; PAIR[a|b], a struct of two values named a and b.
FORMS = {r"ASUM\[([^\[\]]*)\]": (r"aggregate(\1, CAST(0 AS DOUBLE), (acc, w) -> acc + w)", r"list_sum(\1)"), r"HEX\[([^\[\]]*)\]": (r"CAST(conv(\1, 16, 10) AS BIGINT)", r"CAST('0x' || \1 AS BIGINT)"), r"JSON\[([^\[\]|]*)\|(\w+)\]": (r"get_json_object(\1, '$.\2')", r"json_extract_string(\1, '$.\2')"), r"PAIR\[([^\[\]|]*)\|([^\[\]|]*)\]": (r"named_struct('a', \1, 'b', \2)", r"struct_pack(a := \1, b := \2)")}


def _in(text: str, engine: int) -> str:
    for k, v in FORMS.items():
        text = re.sub(k, v[engine], text)
    for k, v in NAMES.items():
        text = re.sub(rf"(?<![A-Z_]){re.escape(k)}", v[engine], text)
    return text


def spark(text: str) -> str:
    return _in(text, 0)


def duck(text: str) -> str:
    return _in(text, 1)


SERIES = "PARTITION BY symbol ORDER BY timestamp"


def frame(rows: int | None, prior: bool = False) -> str:
    """OVER clause of the last `rows` bars (all so far: None), with the current one or strictly before it."""
    start = "UNBOUNDED" if rows is None else str(rows if prior else rows - 1)
    return f"OVER ({SERIES} ROWS BETWEEN {start} PRECEDING AND {'1 PRECEDING' if prior else 'CURRENT ROW'})"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({SERIES})"


def roll(agg: str, x: str, rows: int | None, least: int = 1, prior: bool = False) -> str:
    """Rolling aggregate, null where fewer than `least` values are in the frame. agg: a name, or text with {x}."""
    over = frame(rows, prior)
    call = agg.format(x=x) if "{x}" in agg else f"{agg}({x})"
    return f"CASE WHEN count({x}) {over} >= {least} THEN {call} {over} END"


def pct(x: str, p: float, rows: int | None, least: int = 1, prior: bool = False) -> str:
    return roll(f"PCT({{x}}, {p})", x, rows, least, prior)


def clip(x: str, lo: float | str, hi: float | str) -> str:
    """Bounded to [lo, hi]; null stays null."""
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END"


def rows_of(x: str, rows: int, prior: bool = False) -> str:
    """The values of x in a frame, oldest first."""
    return f"LIST({x}) {frame(rows, prior)}"


#: Coefficients of Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _horner(c: tuple[float, ...], x: str) -> str:
    out = repr(c[0])
    for a in c[1:]:
        out = f"({out} * {x} + {a!r})"
    return out


def normal_quantile(p: str) -> str:
    """Inverse of the normal distribution, for p in (0, 1); error below 1.2e-9."""
    q, r, low, high = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda t: f"{_horner(_C, t)} / {_horner(_D, t)}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 0.97575 THEN -({tail(high)}) ELSE {q} * {_horner(_A, r)} / {_horner(_B, r)} END"


def normal_cdf(x: str) -> str:
    """Normal distribution by the rational approximation 7.1.26 of Abramowitz and Stegun; error below 1.5e-7."""
    z = f"(abs({x}) / {2 ** 0.5!r})"
    t = f"(1 / (1 + 0.3275911 * {z}))"
    erf = f"(1 - {_horner((1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592, 0.0), t)} * exp(-{z} * {z}))"
    return f"(0.5 * (1 + CASE WHEN {x} < 0 THEN -1 ELSE 1 END * {erf}))"
