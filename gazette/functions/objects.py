"""JSON as language models write it: the object in an answer, found by a fold over the answer's signs and read by Spark's own parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An escaped sign, a run of ordinary ones, or one sign.
SIGNS = r"(?s)\\.|[^\\\"{}\[\]]+|."
#: Balanced objects that are tried.
MOST = 5


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, or a number's type."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def part(v: Column, name: str) -> Column:
    """A field of an object; null where there is none."""
    return F.try_variant_get(v, f"$['{name}']", "variant")


def text_of(v: Column) -> Column:
    """A string's value."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def listed(v: Column) -> Column:
    """An array's values."""
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def balanced(said: Column) -> Column:
    """The first objects whose braces balance outside of strings. The fold holds place, depth, whether it is in a string, and where
    the object began; a backslash escapes in strings only."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("begin"), F.array().cast("array<struct<begin:int,many:int>>").alias("found"))

    def step(acc, sign):
        c = F.when(acc["quoted"] & (F.length(sign) > 1), F.lit("")).otherwise(F.right(sign, F.lit(1)))
        opened, closed = ~acc["quoted"] & (c == "{"), ~acc["quoted"] & (c == "}") & (acc["depth"] > 0)
        end, at = acc["pos"] + F.length(sign), acc["pos"] + F.length(sign) - 1
        whole = closed & (acc["depth"] == 1) & (F.size(acc["found"]) < MOST)
        one = F.array(F.struct(acc["begin"].alias("begin"), (end - acc["begin"]).alias("many")))
        return F.struct(
            end.alias("pos"), (acc["depth"] + opened.cast("int") - closed.cast("int")).alias("depth"), F.when(c == '"', ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"),
            F.when(opened & (acc["depth"] == 0), at).otherwise(acc["begin"]).alias("begin"), F.when(whole, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"),
        )

    found = F.aggregate(F.regexp_extract_all(said, F.lit(SIGNS), F.lit(0)), start, step)["found"]
    return F.transform(found, lambda x: F.substring(said, x["begin"] + 1, x["many"]))


def repaired(said: Column) -> Column:
    """From the first object on, cut after the last closed bracket, with what is open then closed."""
    begin = F.when(F.contains(said, F.lit('{"')), F.instr(said, '{"')).otherwise(F.instr(said, "{"))
    part = F.substring(said, begin, F.length(said))
    part = F.coalesce(F.nullif(F.regexp_extract(part, r"(?s)^(.*[}\]])", 1), F.lit("")), part)
    start = F.struct(F.lit(False).alias("quoted"), F.array().cast("array<string>").alias("open"))

    def step(acc, sign):
        c = F.when(acc["quoted"] & (F.length(sign) > 1), F.lit("")).otherwise(F.right(sign, F.lit(1)))
        free, depth = ~acc["quoted"], F.size(acc["open"])
        stack = F.when(free & (c == "{"), F.concat(F.array(F.lit("}")), acc["open"])).when(free & (c == "["), F.concat(F.array(F.lit("]")), acc["open"]))
        stack = stack.when(free & c.isin("}", "]") & (depth > 0), F.slice(acc["open"], F.lit(2), F.greatest(depth - 1, F.lit(0)))).otherwise(acc["open"])
        return F.struct(F.when(c == '"', ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"), stack.alias("open"))

    closing = F.array_join(F.aggregate(F.regexp_extract_all(part, F.lit(SIGNS), F.lit(0)), start, step)["open"], "")
    return F.when(begin > 0, F.concat(part, closing))


def object_in(output: Column) -> Column:
    """The JSON object in an answer, as compact JSON text with sorted names; null when there is none. Balanced blocks come first, then
    first to last brace, the whole, and a repair of a cut one; each as it is and without trailing commas. What follows a complete
    object doesn't count."""
    said = F.trim(F.coalesce(output, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    # most answers hold one object and no quote before it: where that is read as it stands, it is the first that balances
    plain = F.try_parse_json(F.nullif(F.regexp_extract(said, r'(?s)^[^"{]*+(\{.*\})', 1), F.lit("")))
    outer = F.filter(F.array(F.nullif(F.regexp_extract(said, r"(?s)(\{.*\})", 1), F.lit("")), said, repaired(said)), lambda t: t.isNotNull())
    tries = F.flatten(F.transform(F.concat(balanced(said), outer), lambda t: F.array(t, F.regexp_replace(t, r",\s*([}\]])", "$1"))))
    read = F.filter(F.transform(tries, lambda t: F.try_parse_json(t)), lambda v: v.isNotNull() & (kind(v) == "OBJECT"))
    return F.when(F.contains(said, F.lit("{")), F.coalesce(F.when(kind(plain) == "OBJECT", F.to_json(plain)), F.to_json(F.get(read, 0))))
