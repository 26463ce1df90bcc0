"""JSON in one form for each value: keys in order, no spaces, numbers as few digits as tell them apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType

#: Control characters whose escape Spark writes with a capital digit.
_CAPITAL = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shortest_decimal(number: Column) -> Column:
    """A double in the fewest digits that give it again: with an exponent of two digits at least below 1e-4 and from 1e16
    on, else plain and with a point. Minus zero and what isn't finite give null: they have no canonical form.
    Of two numbers of 17 digits that read as the same double from 4e37 on, the one that Spark prints is taken."""

    def told(x: Column) -> Column:
        digits, point = x["digits"], x["point"]
        power, rest = point - 1, F.substring(x["digits"], 2, 400)
        scientific = F.concat(
            F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string")
        )
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        whole = F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0"))
        after = F.substring(digits, point + 1, F.lit(400))
        plain = F.concat(whole, F.lit("."), F.when(after == "", "0").otherwise(after))
        return F.when((power < -4) | (power >= 16), scientific).when(point <= 0, small).otherwise(plain)

    def shortened(x: Column) -> Column:
        """Spark may give more digits than needed, 16 at least or those of the least doubles: the fewest that read as the
        same double, rounded from what it gives."""
        n = F.length(x["digits"])

        def rounded(k: Column) -> Column:
            up = F.when(F.substring(x["digits"], k + 1, F.lit(1)) >= "5", 1).otherwise(0)
            q = (F.substring(x["digits"], F.lit(1), k).cast("decimal(20,0)") + up).cast("string")
            return F.struct(q.alias("q"), (x["point"] + F.length(q) - k).alias("point"), F.concat(q, F.lit("E"), (x["point"] - k).cast("string")).cast("double").alias("d"))

        fewer = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(17))), rounded), lambda r: r["d"] == x["d"]), F.lit(0))
        own = F.struct(x["digits"].alias("digits"), x["point"].alias("point"))
        other = _held(fewer, lambda r: F.struct(F.regexp_replace(r["q"], "0+$", "").alias("digits"), r["point"].alias("point")))
        return F.when((n <= 15) & (x["d"] > 2.3e-308), own).otherwise(other)

    def placed(x: Column) -> Column:
        """Digits without the zeros around them, and the place of the point before the first of them."""
        lead = F.length(F.regexp_extract(x["all"], "^0*", 0))
        return F.struct(F.regexp_replace(x["all"], "^0+|0+$", "").alias("digits"), (x["whole"] - lead + x["e"]).alias("point"), x["d"].alias("d"))

    def parted(said: Column) -> Column:
        # All digits of whole numbers up to 4e37: a long of 62 bits times a power of two.
        shift = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(said["d"])) - 61, F.lit(0)))
        whole = (said["d"] / shift).cast("long").cast("decimal(19,0)") * shift.cast("long").cast("decimal(19,0)")
        exact = (said["d"] >= 1e16) & (said["d"] < 4e37)
        parts = F.split(F.when(exact, F.concat(whole.cast("string"), F.lit("."))).otherwise(said["text"]), "[.E]")
        return F.struct(F.concat(parts[0], parts[1]).alias("all"), F.length(parts[0]).alias("whole"), F.coalesce(F.get(parts, F.lit(2)).cast("int"), F.lit(0)).alias("e"), said["d"].alias("d"))

    d = number.cast("double")
    said = F.struct(F.abs(d).cast("string").alias("text"), F.abs(d).alias("d"))
    text = F.when(d == 0, "0.0").otherwise(_held(_held(_held(_held(said, parted), placed), shortened), told))
    fine = (F.abs(d) < float("inf")) & ~F.isnan(d) & ~((d == 0) & (d.cast("string") == "-0.0"))
    return F.when(fine, F.concat(F.when(d < 0, "-").otherwise(""), text))


def json_text(text: Column) -> Column:
    """A string in quotes, only what has to be escaped is."""
    quoted = F.to_json(F.array(text))
    out = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    for code in _CAPITAL:
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return out


def canonical_json(value: Column, kind: DataType) -> Column:
    """``value`` as canonical JSON: keys in order at every depth, null as such. Null where a number in it has no canonical
    form. ``kind`` is the column's type; maps need string keys."""
    if isinstance(kind, StructType):
        named = sorted(kind.fields, key=lambda f: f.name)
        inner = [F.concat(json_text(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType)) for f in named]
        text = F.concat(F.lit("{"), *[x for k, c in enumerate(inner) for x in ([F.lit(","), c] if k else [c])], F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = _joined("[", F.transform(value, lambda x: canonical_json(x, kind.elementType)), "]")
    elif isinstance(kind, MapType):
        pairs = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(json_text(k), F.lit(":"), canonical_json(F.element_at(value, k), kind.valueType)))
        text = _joined("{", pairs, "}")
    elif isinstance(kind, StringType):
        text = json_text(value)
    elif isinstance(kind, (DoubleType, FloatType)):
        text = shortest_decimal(value)
    elif isinstance(kind, (IntegralType, BooleanType)):
        text = value.cast("string")
    else:
        raise ValueError(f"{kind.simpleString()} has no canonical JSON")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def _joined(opening: str, items: Column, closing: str) -> Column:
    whole = F.forall(items, lambda x: x.isNotNull())
    return F.when(whole, F.concat(F.lit(opening), F.array_join(items, ","), F.lit(closing)))


def repeats_key(line: Column) -> Column:
    """Whether an object of a JSON text, at any depth, has a key twice: one pass over its strings and braces, with the keys
    seen so far of each object that is open. Strings' contents are never taken for structure."""
    tokens = F.regexp_extract_all(line, F.lit(r'"(?:[^"\\]|\\.)*"\s*:?|[{}]'), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("open"), F.lit(False).alias("twice"))

    def step(state: Column, token: Column) -> Column:
        key = F.try_variant_get(F.try_parse_json(F.regexp_replace(token, r"\s*:$", "")), "$", "string")
        top, below = F.get(state["open"], F.lit(0)), F.slice(state["open"], F.lit(2), F.greatest(F.size(state["open"]), F.lit(1)))
        with_key = lambda k: F.struct(F.concat(F.array(F.concat(top, F.array(k))), below).alias("open"), (state["twice"] | F.coalesce(F.array_contains(top, k), F.lit(False))).alias("twice"))
        return (
            F.when(token == "{", F.struct(F.concat(F.array(none), state["open"]).alias("open"), state["twice"].alias("twice")))
            .when(token == "}", F.struct(below.alias("open"), state["twice"].alias("twice")))
            .when(F.endswith(token, F.lit(":")) & (F.size(state["open"]) > 0), _held(key, with_key))
            .otherwise(state)
        )

    return F.aggregate(tokens, start, step, lambda s: s["twice"])
