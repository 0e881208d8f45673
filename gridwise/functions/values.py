"""Cell values as Column expressions: three kinds of blank, comparison keys, identities and conversions.

A cell's kind comes from its column's static type: string, number, boolean or date. All rules are built-in expressions,
so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that cell texts are trimmed of, and day 0 of serial dates.
WHITE = r"[\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
EPOCH = "1899-12-30"
MOST_SERIAL = 60000


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "string"


def trim(c: Column) -> Column:
    """Without white space of any script at the ends; null stays null."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def text(c: Column) -> Column:
    """Trimmed text; null is empty."""
    return F.coalesce(trim(c.cast("string")), F.lit(""))


def target_blank(c: Column, kind: str = "string") -> Column:
    """Null, empty, or false: may be filled."""
    if kind == "boolean":
        return F.coalesce(~c, F.lit(True))
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def source_blank(c: Column, kind: str = "string") -> Column:
    """Null or empty: nothing to write. False is a value."""
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def audit_blank(c: Column) -> Column:
    """Null or white space only."""
    return text(c) == ""


def pad2(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used: generated code stays small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number_text(c: Column) -> Column:
    """The shortest decimal of a double: 5, 1.5, 10000000; 1e21 and up, and below 1e-6, with an exponent."""

    def shown(x: Column) -> Column:
        sign, size = F.when(x < 0, "-").otherwise(""), F.abs(x)
        digits = F.regexp_replace(size.cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
        raised = F.lower(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1"))
        return F.when(x == 0, "0").when((size < 1e21) & (x == F.floor(x)), x.cast("decimal(38,0)").cast("string")).when((size >= 1e-6) & (size < 1e-3) | (size >= 1e7) & (size < 1e21), F.concat(sign, digits)).otherwise(raised)

    return let(c, shown)


def display_date(t: Column) -> Column:
    """date:YYYY-MM-DD of M/D/YYYY or YYYY-M-D, no calendar asked; null for other texts."""
    us, iso = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(t, pattern, k)

    return F.when(t.rlike(us), F.concat(F.lit("date:"), part(us, 3), F.lit("-"), pad2(part(us, 1)), F.lit("-"), pad2(part(us, 2)))).when(
        t.rlike(iso), F.concat(F.lit("date:"), part(iso, 1), F.lit("-"), pad2(part(iso, 2)), F.lit("-"), pad2(part(iso, 3)))
    )


def key(c: Column, kind: str = "string") -> Column:
    """What two cells are compared by: equal keys mean equal cells, whatever their types."""
    if kind == "boolean":
        return F.when(target_blank(c, kind), "blank:").otherwise("boolean:true")
    if kind == "number":
        x = c.cast("double")
        odd = F.isnan(x) | x.isin(float("inf"), float("-inf"))
        return F.when(x.isNull(), "blank:").when(odd, F.concat(F.lit("string:"), x.cast("string"))).otherwise(F.concat(F.lit("number:"), number_text(x)))
    if kind == "date":
        return F.when(c.isNull(), "blank:").otherwise(F.concat(F.lit("date:"), F.date_format(c, "yyyy-MM-dd")))

    def of(t: Column) -> Column:
        return (
            F.when(t.isNull() | (t == ""), "blank:")
            .when(F.lower(t).isin("true", "false"), F.concat(F.lit("boolean:"), F.lower(t)))
            .when(t.rlike(r"^-?\d+(\.\d+)?$"), F.concat(F.lit("number:"), number_text(t.try_cast("double"))))
            .otherwise(F.coalesce(display_date(t), F.concat(F.lit("string:"), t)))
        )

    return let(trim(c), of)


def same(a: Column, b: Column, kind_a: str = "string", kind_b: str = "string") -> Column:
    return key(a, kind_a) == key(b, kind_b)


def identity(c: Column) -> Column:
    """A trimmed identity; the words undefined and null are blank."""
    t = text(c)
    return F.when(t.isin("undefined", "null"), "").otherwise(t)


def normal_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def write_value(c: Column) -> Column:
    """A source text as it is written: true and false in lower case."""
    t = F.lower(trim(c))
    return F.when(t.isin("true", "false"), t).otherwise(c)


def to_date(c: Column) -> Column:
    """A date of a serial number of days, M/D/YYYY or YYYY-M-D; days and months that overflow roll over."""
    t = trim(c.cast("string"))
    serial = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
    shown = F.regexp_extract(display_date(t), r"^date:(\d+)-(\d+)-(\d+)$", 1), F.regexp_extract(display_date(t), r"^date:(\d+)-(\d+)-(\d+)$", 2), F.regexp_extract(display_date(t), r"^date:(\d+)-(\d+)-(\d+)$", 3)
    year, month, day = (x.try_cast("int") for x in shown)
    rolled = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)
    return F.when((serial >= 1) & (serial <= MOST_SERIAL), F.date_add(F.lit(EPOCH).cast("date"), F.floor(serial).cast("int"))).when(display_date(t).isNotNull(), rolled)


def to_number(c: Column) -> Column:
    """A finite number; blank and other texts are null."""
    t = trim(c.cast("string"))
    return F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), t.try_cast("double"))


def column_letter(i: Column) -> Column:
    """A, B, ... Z, AA, ... of a position from 0, for up to three letters."""

    def letter(x: Column) -> Column:
        return F.chr(65 + F.pmod(x, F.lit(26)))

    two, three = F.floor(i / 26) - 1, F.floor((F.floor(i / 26) - 1) / 26) - 1
    return F.concat(F.when(three >= 0, letter(three)).otherwise(""), F.when(two >= 0, letter(two)).otherwise(""), letter(i))


def fingerprint(lines: Column) -> Column:
    """SHA-256 of the sorted lines (an array), one on each line."""
    return F.sha2(F.array_join(F.array_sort(lines), "\n"), 256)


def safe_name(c: Column, most: int = 180) -> Column:
    """A text that can name a file or a sheet."""
    return F.left(trim(F.regexp_replace(text(c), r"[\\/?*\[\]:]", " ")), F.lit(most))


def first_filled(*columns: Column) -> Column:
    """The first text that isn't blank; empty if all are, or there is none."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in columns], F.lit(""))


def any_filled(*columns: Column) -> Column:
    """Whether a row holds anything but white space."""
    return F.greatest(*[text(c) != "" for c in columns], F.lit(False)) if columns else F.lit(False)


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def strictly_true(c: Column, kind: str) -> Column:
    """Whether a cell is a boolean true; the text TRUE and the number 1 aren't."""
    return F.coalesce(c, F.lit(False)) if kind == "boolean" else F.lit(False)


def with_dashes(c: Column) -> Column:
    """Lower case with dashes and single spaces kept: dashes of any kind are one, without spaces around."""
    t = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[\u2010-\u2015]", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\s*-\s*", "-"), "[^a-z0-9 -]", ""))


def is_on(c: Column) -> Column:
    """A switch of a settings table; blank is on."""
    return F.lower(trim(F.coalesce(c.cast("string"), F.lit("")))).isin("", "yes", "y", "true", "enabled")


def in_tab(tab: Column, range_: str) -> Column:
    """A range with its quoted tab."""
    quoted = F.concat(F.lit("'"), F.replace(F.coalesce(tab, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.concat(quoted, F.lit(f"!{range_}")) if range_ else quoted


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def encoded_apart(kind: T.DataType) -> bool:
    """Whether a cast to text and back wouldn't keep values of the type."""
    return _nested(kind) or isinstance(kind, T.BinaryType)


def encoded(c: Column, kind: T.DataType) -> Column:
    """A cell of any type as a text that :func:`decoded` reads back; null stays null. Nested values are JSON, bytes are base 64."""
    if _nested(kind):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def decoded(c: Column, kind: T.DataType) -> Column:
    """What :func:`encoded` made a text of; a text that isn't a value of the type is null."""
    if _nested(kind):
        return F.from_json(c, kind)
    return F.unbase64(c) if isinstance(kind, T.BinaryType) else c.try_cast(kind)
