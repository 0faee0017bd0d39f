"""Strict reading of JSON lines with built-in functions only.

Spark's reader ignores text after the first value and turns scalars into bare text. Both are
solved by one rewrite of the line before it is parsed:

* escaped backslashes and quotes are spelled as \\u005c and \\u0022, so every quote left opens
  or closes a string, and each string (names and values alike) gets the prefix "_". After
  parsing, text that starts with "_" was a string; "{" an object, "[" a list, else a literal.
* the line becomes the first member of an object whose last member is a seal. The seal is
  only seen when the whole line is exactly one JSON value, and no line can forge it because
  its own strings all start with "_".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.functions.text import distinct_texts, let, strip, whole_number

_STRICT = {"allowSingleQuotes": "false"}
# Reading goes on after an error inside a member; the column named here tells that there was one.
_NOTED = {**_STRICT, "columnNameOfCorruptRecord": "bad"}


def mark_strings(line: Column) -> Column:
    spelled = F.replace(line, F.lit("\\\\"), F.lit("\\u005c"))
    spelled = F.replace(spelled, F.lit('\\"'), F.lit("\\u0022"))
    # Most lines have no backslash at all.
    plain = F.when(F.contains(line, F.lit("\\")), spelled).otherwise(line)
    return F.regexp_replace(plain, '"([^"]*)"', '"_$1"')


def unmark(text: Column) -> Column:
    return F.regexp_replace(text, '"_([^"]*)"', '"$1"')


def _fields(*names: str) -> str:
    return ", ".join(f"_{n} STRING" for n in names)


def _sealed(line: Column) -> Column:
    return F.concat(F.lit('{"_":'), mark_strings(line), F.lit(',"seal":1}'))


def sealed_object(line: Column, *names: str) -> Column:
    """struct(_ struct<_name...>, seal, bad): see `is_sound`; for lines that hold an object."""
    schema = f"_ STRUCT<{_fields(*names)}>, seal INT, bad STRING"
    return F.from_json(_sealed(line), schema, _NOTED)


def sealed_value(line: Column) -> Column:
    """struct(_, seal, bad) for lines that hold any JSON value."""
    return F.from_json(_sealed(line), "_ STRING, seal INT, bad STRING", _NOTED)


def is_sound(parsed: Column) -> Column:
    """Whether the line was exactly one well-formed JSON value."""
    return parsed["seal"].isNotNull() & parsed["bad"].isNull()


def has_foreign_number(line: Column) -> Column:
    """Whether a number outside strings is spelled in a way that only Spark's reader accepts."""
    bare = F.regexp_replace(mark_strings(line), '"[^"]*"', "")
    return F.contains(line, F.lit("INF")) & bare.rlike("[+-]INF") | F.contains(line, F.lit("+Infinity")) & bare.contains("+Infinity")


def child_object(text: Column, *names: str) -> Column:
    """Fields of a marked value; all null where it is not an object."""
    return F.from_json(F.when(is_object(text), text), _fields(*names), _STRICT)


def is_object(text: Column) -> Column:
    return text.startswith("{")


def is_list(text: Column) -> Column:
    return text.startswith("[")


def scalar_text(text: Column) -> Column:
    """Marked value as plain text; containers keep their JSON text."""
    return (
        F.when(text.startswith("_"), F.substr(text, F.lit(2)))
        .when(text == "true", "True")
        .when(text == "false", "False")
        .when(is_object(text) | is_list(text), unmark(text))
        .otherwise(text)
    )


def number(text: Column, default: int) -> Column:
    """Integer of a marked value: strings must be whole numbers, JSON numbers are cut."""
    as_bool = F.when(text == "true", 1).when(text == "false", 0).cast("bigint")
    cut = F.when(text.rlike("^-?[0-9]"), text.try_cast("double").try_cast("bigint"))
    quoted = F.when(text.startswith("_"), whole_number(F.substr(text, F.lit(2)), default))
    rest = F.coalesce(as_bool, quoted, cut, F.lit(default).cast("bigint"))
    return F.when(text.rlike(r"^[0-9]{1,18}\z"), text.try_cast("bigint")).otherwise(rest)


def text_list(text: Column) -> Column:
    """A list value as distinct cleaned texts; a scalar as a list of itself, untouched."""
    items = F.transform(
        F.from_json(F.when(is_list(text), text), "array<string>", _STRICT), scalar_text
    )
    return (
        F.when(text.isNull() | text.isin("_", "null"), F.array().cast("array<string>"))
        .when(is_list(text), distinct_texts(F.filter(items, lambda x: x.isNotNull())))
        .otherwise(F.array(scalar_text(text)))
    )


def _pairs(text: Column) -> Column:
    """Members of an object as array<struct<k, v>>; the last of repeated names counts."""

    def at(found: Column, i: Column) -> Column:
        return F.coalesce(F.get(found, i)["key"], F.lit(""))

    def last_of_each(found: Column) -> Column:
        # Sorted by name and place, the first of a run has the place and the last the value.
        placed = F.transform(found, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value")))

        def merged(runs: Column) -> Column:
            first = F.filter(runs, lambda p, i: (i == 0) | (at(runs, i - 1) != p["key"]))
            last = F.filter(runs, lambda p, i: (i == F.size(runs) - 1) | (at(runs, i + 1) != p["key"]))
            both = F.zip_with(first, last, lambda x, y: F.struct(x["i"].alias("i"), x["key"].alias("k"), y["value"].alias("v")))
            return F.transform(F.sort_array(both), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))

        every = F.transform(found, lambda p: F.struct(p["key"].alias("k"), p["value"].alias("v")))
        distinct = F.array_distinct(F.transform(found, lambda p: p["key"]))
        return F.when(F.size(distinct) == F.size(found), every).otherwise(let(F.sort_array(placed), merged))

    return let(F.map_entries(F.from_json(text, "map<string,string>", _STRICT)), last_of_each)


def _members(text: Column) -> Column:
    """Direct members of a container as array<struct<k, v>>; list items have a null name."""
    items = F.transform(
        F.from_json(text, "array<string>", _STRICT),
        lambda v: F.struct(F.lit(None).cast("string").alias("k"), v.alias("v")),
    )
    return F.when(is_object(text), _pairs(text)).otherwise(items)


def _is_container(text: Column) -> Column:
    return is_object(text) | is_list(text)


def _scalars(members: Column) -> Column:
    """Named scalars among the members, names in lower case, values as plain text."""
    kept = F.filter(
        members,
        lambda m: m["k"].isNotNull() & m["v"].isNotNull() & (m["v"] != "_") & ~_is_container(m["v"]),
    )
    return F.transform(
        kept,
        lambda m: F.struct(
            F.lower(F.substr(m["k"], F.lit(2))).alias("k"), scalar_text(m["v"]).alias("v")
        ),
    )


def _depth(text: Column) -> Column:
    """Greatest number of containers open at once; brackets inside strings do not count."""
    brackets = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), r"[^{}\[\]]+", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(s: Column, bracket: Column) -> Column:
        now = s["open"] + F.when(bracket.isin("{", "["), 1).when(bracket.isin("}", "]"), -1).otherwise(0)
        return let(now, lambda n: F.struct(n.alias("open"), F.greatest(s["most"], n).alias("most")))

    return F.aggregate(F.split(brackets, ""), start, step, lambda s: s["most"])


def leaves(text: Column) -> Column:
    """All named scalars of a marked object, breadth first, as array<struct<k, v>>.

    A flat object is read in one step. Otherwise the walk goes one nesting level per step; what
    each level holds is kept apart and flattened once at the end.
    """
    level = "array<string>"
    pairs = "array<struct<k:string,v:string>>"
    start = F.struct(
        F.array(text).cast(level).alias("level"), F.array().cast(f"array<{pairs}>").alias("found")
    )

    def step(state: Column, _: Column) -> Column:
        def advance(members: Column) -> Column:
            inner = F.filter(members, lambda m: _is_container(m["v"]))
            return F.struct(
                F.transform(inner, lambda m: m["v"]).alias("level"),
                F.array_append(state["found"], _scalars(members)).alias("found"),
            )

        return let(F.flatten(F.transform(state["level"], _members)), advance)

    walked = F.aggregate(F.sequence(F.lit(1), _depth(text)), start, step, lambda s: F.flatten(s["found"]))
    return (
        F.when(text.isNull() | ~is_object(text) | (text == "{}"), F.array().cast(pairs))
        .when(text.rlike(r"^[{][^{\[]*\z"), _scalars(_pairs(text)))
        .otherwise(walked)
    )


def first_leaf(found: Column, names: list[str]) -> Column:
    """Value of the first leaf with one of the names (any case), else "-"."""
    hits = F.filter(found, lambda p: p["k"].isin(names))
    return F.coalesce(F.get(hits, F.lit(0))["v"], F.lit(dims.MISSING))
