"""Column functions on exact text: nothing is coerced that a rule doesn't name."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space at the ends of a cell.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _edge(c: Column, at: int) -> Column:
    """Whether the character there is white space: a look-up, where trimming would compare every end with every code point."""
    return F.substring(c, at, 1).isin(list(WHITE_SPACE))


def _edges(c: Column) -> Column:
    return _edge(c, 1) | _edge(c, -1)


def trimmed(c: Column) -> Column:
    """Without white space at the ends; few texts have any."""
    return F.when(_edges(c), F.btrim(c, F.lit(WHITE_SPACE))).otherwise(c)


def blank(c: Column) -> Column:
    """Nothing but white space; a null is blank."""
    return F.when(c.isNull() | (c == ""), True).when(_edge(c, 1), F.btrim(c, F.lit(WHITE_SPACE)) == "").otherwise(False)


def padded(c: Column) -> Column:
    return F.coalesce(_edges(c), F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """Full match: unlike ^ and $ it leaves no room for a line end."""
    return F.coalesce(c.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def date_of(c: Column) -> Column:
    """The date of a text YYYY-MM-DD in the years 1 to 9999, else null."""
    return F.when(matches(c, "(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}"), c.try_cast("date"))


def iso_date(c: Column) -> Column:
    return date_of(c).isNotNull()


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Full case folding by this Python's Unicode data: letters that fold to one letter and what to, and those that fold to several."""
    folded = {c: f for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if (f := c.casefold()) != c}
    one = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in folded.items() if len(f) > 1}


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def fold(c: Column) -> Column:
    """Text for comparison without case: full case folding, letter by letter as str.casefold has it. ASCII texts are just lower-cased."""
    letters, to, several = _folds()
    table = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    long = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(_ascii(c), F.lower(c)).otherwise(F.translate(F.when(c.rlike(f"[{''.join(several)}]"), long).otherwise(c), letters, to))


def formula_safe(c: Column) -> Column:
    """Guard cells that a spreadsheet would run: an apostrophe before what, white space aside, starts with = + - @."""
    return F.when(F.ltrim(c, F.lit(WHITE_SPACE)).rlike(r"\A[=+\-@]") | c.rlike(r"\A[\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def formula_safe_strict(c: Column) -> Column:
    """The narrower rule of approved-document exports: only the very first character counts."""
    return F.when(c.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


@functools.cache
def _digits() -> tuple[str, str]:
    """Decimal digits of all scripts but ASCII's own, and their values."""
    found = [c for c in map(chr, range(0x80, 0x110000)) if c.isdecimal()]
    return "".join(found), "".join(str(int(c)) for c in found)


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f asks for it: expressions put into each other would grow by products."""
    return F.get(F.transform(F.array(c), f), 0)


def cents_of(c: Column) -> Column:
    """Whole cents of an amount: at most two decimals that aren't zero, 0 to 10**12; else null.

    An amount is a decimal number of any length, with an exponent or without; commas, underscores and outer white space
    don't count, and digits may be of any script. It is read exactly: as its digits without the zeros around them, and how many tens
    they are to be multiplied by. An empty text is null as well; `amount_valid` tells the two apart. The plain form, up to twelve ASCII
    digits and up to two decimals, is read by a cast, which is exact for it.
    """
    plain = (c.try_cast("decimal(14,2)") * 100).cast("bigint")
    nothing = F.lit(None).cast("bigint")
    return F.when(c == "", nothing).when(matches(c, r"[0-9]{1,12}(?:\.[0-9]{1,2})?"), plain).otherwise(_let(c, _cents))


def _cents(c: Column) -> Column:
    """Of an amount in any form."""
    bare = F.replace(trimmed(F.replace(c, F.lit(","), F.lit(""))), F.lit("_"), F.lit(""))
    ascii_ = lambda t: F.lower(F.when(_ascii(t), t).otherwise(F.translate(t, *_digits())))
    number = lambda t: F.when(matches(t, r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?"), t)
    return _let(_let(_let(bare, ascii_), number), _cents_of_number)


def _cents_of_number(number: Column) -> Column:
    exponent = F.when(F.contains(number, F.lit("e")), F.substring_index(number, "e", -1)).otherwise("0").try_cast("int")
    negative = F.startswith(number, F.lit("-"))

    def of_mantissa(mantissa: Column) -> Column:
        whole = F.substring_index(mantissa, ".", 1)
        part = F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise("")
        digits = lambda part: _let(F.ltrim(F.concat(whole, part), F.lit("0")), lambda digits: of_digits(digits, F.char_length(part)))
        return _let(part, digits)

    def of_digits(digits: Column, decimals: Column) -> Column:
        # cents are kept x 10 ** tens
        of_kept = lambda kept: _let(F.char_length(digits) - F.char_length(kept) - decimals + exponent.cast("bigint") + 2, lambda tens: of_tens(kept, tens))
        return _let(F.rtrim(digits, F.lit("0")), of_kept)

    def of_tens(kept: Column, tens: Column) -> Column:
        cents = F.when((tens >= 0) & (tens + F.char_length(kept) <= 15) & ~negative, F.concat(kept, F.repeat(F.lit("0"), tens.cast("int"))).try_cast("bigint"))
        return F.when(kept == "", F.lit(0).cast("bigint")).otherwise(_let(cents, lambda cents: F.when(cents <= 100_000_000_000_000, cents)))

    return _let(F.ltrim(F.substring_index(number, "e", 1), F.lit("+-")), of_mantissa)


def unreadable(c: Column, cents: Column) -> Column:
    """Whether a text that isn't blank has no cents."""
    return cents.isNull() & ~blank(c)


def amount_valid(c: Column) -> Column:
    return ~unreadable(c, cents_of(c))


def money(cents: Column) -> Column:
    """Cents as text with two decimals."""
    return F.format_string("%d.%02d", ((cents - F.pmod(cents, F.lit(100))) / 100).cast("bigint"), F.pmod(cents, F.lit(100)).cast("int"))


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """The texts of the conditions that hold, in this order; a null is no text.

    Arrays of one text or none are put together: dropping nulls from one array takes a lambda, with which Spark compiles neither that nor
    the conditions.
    """
    none = F.array().cast("array<string>")
    one = lambda cond, text: (cond & text.isNotNull(), F.array(F.coalesce(text, F.lit("")))) if isinstance(text, Column) else (cond, F.array(F.lit(text)))
    return F.concat(none, *[F.when(*one(cond, text)).otherwise(none) for cond, text in pairs])


def bits(*conditions: Column) -> Column:
    """A whole number with a bit for each condition, the first one lowest, set where it holds: small enough to go through a shuffle."""
    return functools.reduce(Column.bitwiseOR, [F.when(cond, F.lit(1 << k)).otherwise(0) for k, cond in enumerate(conditions)])


def reasons_of(found: Column, *texts: str) -> list[tuple[Column, str]]:
    """The pairs that `reasons` takes, from `bits`."""
    return [(found.bitwiseAND(F.lit(1 << k)) != 0, text) for k, text in enumerate(texts)]
