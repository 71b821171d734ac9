"""Small building blocks over columns: bindings, prefix sums, regex spans, masking."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 128
_built: dict = {}


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column a function builds from plain values; large expressions take a while to build."""

    @functools.wraps(make)
    def cached(*args):
        context = SparkContext._active_spark_context
        key = (id(context), make.__module__, make.__qualname__, args)
        if key not in _built:
            _built[key] = (context, make(*args))
        return _built[key][1]

    return cached


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    ``element_at`` keeps the type of the body; ``get`` derives it from all of the body again for each row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose expression is never copied into the projections above it.

    Catalyst merges projections around a Python function even when that repeats expensive
    expressions; a one-element explode keeps them apart at the price of a row copy. The explode reads
    a column, as it derives the type of its whole expression again for each row.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, value.alias("_bound")).select(*others, F.explode(F.array("_bound")).alias(name))


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _starts(lengths: Column) -> Column:
    """struct(total, starts): exclusive prefix sums of one short array."""
    zero = F.struct(F.lit(0).alias("total"), empty("int").alias("starts"))
    return F.aggregate(
        lengths,
        zero,
        lambda acc, x: F.struct(
            (acc["total"] + x).alias("total"), F.concat(acc["starts"], F.array(acc["total"])).alias("starts")
        ),
    )


def prefix_sums(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array.

    Arrays are summed block by block, so that a text with very many matches costs
    about n * block copies and not n * n.
    """

    def whole(xs: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(1), F.size(xs), F.lit(_BLOCK)), lambda at: _starts(F.slice(xs, at, F.lit(_BLOCK)))
        )
        return let(
            blocks,
            lambda bs: F.flatten(
                F.zip_with(
                    bs,
                    _starts(F.transform(bs, lambda b: b["total"]))["starts"],
                    lambda b, offset: F.transform(b["starts"], lambda s: s + offset),
                )
            ),
        )

    return let(lengths, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(empty("int")))


SPAN = "struct<start:int,end:int,value:string,tail:string>"
# A character that is none: cutting at one character needs no regex, which ``split`` compiles anew for each text.
_MARK = "\uffff"


def _between(text: Column, pattern: str) -> Column:
    """What lies between the matches of a pattern, from the text's begin to its end."""
    marked = F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern, -1)).otherwise(marked)


def find_all(text: Column, pattern: str, tail_group: int | None = None) -> Column:
    """Every non-overlapping match with code-point offsets, as array<struct<start,end,value,tail>>.

    The pieces between matches and the matches themselves give the offsets by prefix sums;
    ``regexp_instr`` would count UTF-16 units. ``tail`` holds the text of a look-ahead group.
    A row without a match pays for one regex search only.
    """
    regex = F.lit(pattern)

    def spans(p: Column) -> Column:
        lengths = F.zip_with(p["hits"], p["gaps"], lambda h, g: F.length(h) + F.length(g))
        starts = F.zip_with(
            prefix_sums(F.slice(lengths, F.lit(1), F.size(p["hits"]))), p["gaps"], lambda s, g: s + F.length(g)
        )
        rows = F.arrays_zip(
            F.slice(starts, F.lit(1), F.size(p["hits"])).alias("s"), p["hits"].alias("h"), p["tails"].alias("t")
        )
        return F.transform(
            rows,
            lambda r: F.struct(
                r["s"].alias("start"),
                (r["s"] + F.length(r["h"])).cast("int").alias("end"),
                r["h"].alias("value"),
                r["t"].alias("tail"),
            ),
        ).cast(f"array<{SPAN}>")

    def whole(hits: Column) -> Column:
        tails = F.regexp_extract_all(text, regex, F.lit(tail_group)) if tail_group else F.transform(hits, lambda _: F.lit(""))
        pieces = F.struct(_between(text, pattern).alias("gaps"), hits.alias("hits"), tails.alias("tails"))
        return F.when(F.size(hits) > 0, let(pieces, spans)).otherwise(empty(SPAN))

    return let(F.regexp_extract_all(text, regex, F.lit(0)), whole)


def first_match(text: Column, pattern: str, flags: str) -> Column:
    """struct(start, value) of the first match; the caller has checked that there is one.

    The pattern is a literal, so it is compiled once: what is left without the match and all after it is the text before.
    """
    whole = flags + "(?:" + pattern + ")"
    return F.struct(
        F.length(F.regexp_replace(text, whole + "(?s:.*)", "")).alias("start"), F.regexp_extract(text, whole, 0).alias("value")
    )


def edit_matches(
    text: Column, pattern: str, edit: Callable[[Column], Column], guard: str | None = None
) -> Column:
    """Replace each match by ``edit(match)``, keeping everything between matches.

    ``guard`` is a cheaper pattern that every text with a match also matches.
    """
    pieces = F.struct(
        _between(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")
    )

    def join(p: Column) -> Column:
        edited = F.zip_with(p["gaps"], p["hits"], lambda g, h: F.concat(g, F.coalesce(edit(h), F.lit(""))))
        return F.array_join(edited, "")

    hit = F.rlike(text, F.lit(pattern))
    if guard:
        hit = F.rlike(text, F.lit(guard)) & hit
    return F.when(hit, let(pieces, join)).otherwise(text)


def mask(value: Column, keep: int = 2) -> Column:
    """Keep two characters on each side and star the rest (at most twelve stars)."""

    def stars(v: Column) -> Column:
        n = F.length(v)
        return F.when(n <= 2 * keep, F.repeat(F.lit("*"), n)).otherwise(
            F.concat(
                F.left(v, F.lit(keep)),
                F.repeat(F.lit("*"), F.least(n - 2 * keep, F.lit(12))),
                F.right(v, F.lit(keep)),
            )
        )

    return let(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), stars)


def chars(text: Column) -> Column:
    """The code points of a text as an array."""
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def kinds_of_chars(text: Column) -> Column:
    """The different code points of a text in the order of their first places."""
    return F.filter(F.array_distinct(F.split(text, "", -1)), lambda c: c != "")


def joined(items: Column, sep: str = "") -> Column:
    return F.array_join(items, sep)
