"""Dates, guarded numbers, tolerant JSON and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partial_date(text: Column) -> Column:
    """YYYY, YYYY-MM, YYYY-MM-DD or a longer stamp's first ten characters as a date; null when it is none."""
    n = F.length(text)
    full = F.when(n == 4, F.concat(text, F.lit("-01-01"))).when(n == 7, F.concat(text, F.lit("-01"))).otherwise(F.substring(text, 1, 10))
    return F.when(full.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).cast("date"))


def age_at(birth: Column, as_of: Column) -> Column:
    """Full years at `as_of`; -1 without a date of birth."""
    early = F.month(as_of) * 100 + F.dayofmonth(as_of) < F.month(birth) * 100 + F.dayofmonth(birth)
    return F.when(birth.isNull(), F.lit(-1)).otherwise(F.year(as_of) - F.year(birth) - early.cast("int"))


def duration_days(onset: Column, end: Column, as_of: Column) -> Column:
    return F.datediff(F.coalesce(end, as_of), onset)


def number(text: Column) -> Column:
    """The value as a double where the whole text is a number, else null."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))


def python_round(x: Column, digits: int = 0) -> Column:
    """x to `digits` places, half to even, judged by the exact value of the double: 2.675 is a little less than it looks and gives 2.67.

    x * 10 ** digits is split into a product and its exact error, so that what lies on, under or over the half is told apart.
    """
    scale = F.lit(float(10**digits))
    split = lambda a: F.lit(134217729.0) * a - (F.lit(134217729.0) * a - a)
    product = x * scale
    xh, sh = split(x), split(scale)
    xl, sl = x - xh, scale - sh
    error = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
    low = F.floor(product).cast("double")
    part = product - low
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(low, F.lit(2.0)) == 1))))
    return F.when(F.abs(product) >= 2.0**52, x).otherwise(F.when(up, low + 1).otherwise(low) / scale)


def mapped(value: Column, names: dict, otherwise: str = "Other") -> Column:
    """The value's name, or a default where it has none."""
    return F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in names.items()), F.lit(otherwise))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, where an empty whole counts as one."""
    return part / F.greatest(whole, F.lit(1))


def out_of_range(value: Column, low: Column, high: Column) -> Column:
    """Null unless value and both limits are there and not zero."""
    known = (value != 0) & (low != 0) & (high != 0)
    return F.when(known, (value < low) | (value > high))


def json_block(text: Column) -> Column:
    """A JSON object inside a model's answer as VARIANT: the whole text without fences, else from its first to its last brace."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", "")
    whole = F.when(bare.rlike(r"(?s)^\s*\{"), F.try_parse_json(bare))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(whole, F.when(inner != "", F.try_parse_json(inner)))


def json_field(block: Column, name: str, kind: str, default) -> Column:
    return F.coalesce(F.try_variant_get(block, f"$.{name}", kind), F.lit(default))


def message_text(data: Column) -> Column:
    """The text of a base64 message; null where it is none."""
    return F.try_to_binary(data, F.lit("base64")).cast("string")


def message_payload(data: Column, schema: str) -> Column:
    """A base64 JSON message as a struct; its fields are null where the message is none."""
    return F.from_json(message_text(data), schema)


def chunks(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Pieces of `size` characters that overlap; a short text is one piece."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def unit(vector: Column) -> Column:
    """The vector at length one; a zero vector is left as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def distance(a: Column, b: Column) -> Column:
    """1 less the dot product of unit vectors: 0 for the same direction."""
    return 1 - dot(unit(a), unit(b))


def token_estimate(text: Column) -> Column:
    return F.length(text) / F.lit(1.4)
