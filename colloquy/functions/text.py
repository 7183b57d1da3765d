"""Turn text and turn roles, as row-local column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import fixed


def column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda body is re-evaluated per element, so an expression that does not
    depend on the element is bound outside of it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def py_strip(col: Column | str) -> Column:
    """Strip the whitespace that Python's ``str.strip`` strips."""
    return F.btrim(column(col), F.lit(fixed.WHITESPACE))


def clean_text(col: Column | str) -> Column:
    """NULL becomes '', image markers go with the whitespace after them, ends are stripped.

    Most texts hold no marker and are spared the regular expression.
    """
    value = F.coalesce(column(col), F.lit(""))
    marker = fixed.IMAGE_SLOT + fixed.WHITESPACE_CLASS + "*"
    return F.when(
        F.contains(value, F.lit(fixed.IMAGE_SLOT)), py_strip(F.regexp_replace(py_strip(value), marker, ""))
    ).otherwise(py_strip(value))


def is_user(src: Column | str) -> Column:
    return F.coalesce(column(src).isin(*fixed.USER_SOURCES), F.lit(False))


def is_assistant(src: Column | str) -> Column:
    return F.coalesce(column(src).isin(*fixed.ASSISTANT_SOURCES), F.lit(False))


def role_strict(src: Column | str, keep_system: bool = False) -> Column:
    """Message role, NULL for a turn that no message is built from."""
    role = F.when(is_user(src), "user").when(is_assistant(src), "assistant")
    if keep_system:
        role = role.when(column(src) == "system", "system")
    return role


def role_legacy(src: Column | str) -> Column:
    """Transcript speaker: whoever is not the user is the assistant."""
    return F.when(is_user(src), "USER").otherwise("ASSISTANT")


def default_user_text(col: Column | str, fallback: str = "") -> Column:
    """Text of a user turn, ``fallback`` if it is blank."""
    c = F.coalesce(column(col), F.lit(""))
    return F.when(c == "", F.lit(fallback)).otherwise(c)


def _json_literal(a: Column) -> Column:
    """A string literal that escapes only what JSON must: quotes, backslashes and control characters."""
    said = F.get(F.from_json(F.concat(F.lit("["), a, F.lit("]")), "array<string>"), 0)
    written = F.to_json(F.array(said))
    # The writer's escapes of control characters have capital hex digits.
    for digit in "ABCDEF":
        for row in "01":
            written = F.replace(written, F.lit(f"\\u00{row}{digit}"), F.lit(f"\\u00{row}{digit.lower()}"))
    written = F.when(said.isNull(), a).otherwise(F.substring(written, F.lit(2), F.length(written) - 2))
    return F.when(F.contains(a, F.lit("\\u")) | F.contains(a, F.lit("\\/")), written).otherwise(a)


def _json_number(a: Column) -> Column:
    """Shortest digits, positional from 0.0001 up to sixteen places, else with an exponent of two digits or more."""
    shown = a.try_cast("double").cast("string")
    part = lambda k: F.regexp_extract(shown, r"^-?(\d+)\.(\d+)(?:E(-?\d+))?$", k)
    sign = F.when(F.startswith(shown, F.lit("-")), "-").otherwise("")
    raw = F.concat(part(1), part(2))
    digits = F.regexp_replace(F.regexp_replace(raw, "^0+", ""), "0+$", "")
    lost = F.length(raw) - F.length(F.regexp_replace(raw, "^0+", ""))
    exponent = F.length(part(1)) + F.coalesce(part(3).try_cast("int"), F.lit(0)) - lost - 1
    n = F.length(digits)
    tail = lambda first: F.when(n > first, F.substring(digits, F.lit(first + 1), n - first)).otherwise("")
    point = exponent + 1
    positional = (
        F.when(n == 0, "0.0")
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n - point)))
    )
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), tail(1))).otherwise(""), F.lit("e"), power)
    written = F.concat(sign, F.when((n == 0) | exponent.between(-4, 15), positional).otherwise(scientific))
    return F.when(a == "-0", "0").when(a.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$") & a.rlike("[.eE]") & part(1).rlike("."), written).otherwise(a)


def json_one_line(col: Column | str) -> Column:
    """JSON text as its parsed value is written: single spaces after ``,`` and ``:``, no other layout.

    The text is cut into string literals, separators, brackets and other atoms.
    Literals keep only the escapes that they need, fractions and exponents have
    their shortest form, and whole numbers stay digit by digit.
    """
    atoms = F.regexp_extract_all(
        column(col), F.lit(r'"(?:[^"\\]++|\\.)*+"|[,:\[\]{}]|[^\s",:\[\]{}]+'), F.lit(0)
    )

    def written(a: Column) -> Column:
        return (
            F.when(a.isin(",", ":"), F.concat(a, F.lit(" ")))
            .when(F.startswith(a, F.lit('"')), _json_literal(a))
            .when(a.rlike("^-?[0-9]"), _json_number(a))
            .otherwise(a)
        )

    return F.array_join(F.transform(atoms, written), "")
