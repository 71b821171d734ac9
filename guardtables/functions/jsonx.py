"""JSON values: canonical hashes, type tests and leaves."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import let

# Keywords of a JSON schema, its type names, and keys that identify things.
SCHEMA_KEYWORDS = frozenset(
    "$schema $id $ref $defs $anchor $comment type properties patternProperties additionalProperties required "
    "items prefixItems additionalItems contains minContains maxContains allOf anyOf oneOf not if then else "
    "dependentRequired dependentSchemas unevaluatedProperties unevaluatedItems propertyNames enum const default "
    "examples description title format pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf "
    "minLength maxLength minItems maxItems uniqueItems minProperties maxProperties readOnly writeOnly deprecated "
    "contentEncoding contentMediaType".split()
)
SCHEMA_TYPES = frozenset("object array string number integer boolean null".split())
PROPERTY_MAPS = frozenset("properties patternProperties $defs dependentSchemas".split())
IDENTIFIERS = frozenset("name id tool_call_id role type model".split())
FLAGS = frozenset("stream stream_options model".split())
MAX_DEPTH = 32

LEAF = "array<struct<path:string,text:string,is_key:boolean,immutable:boolean>>"


QUOTED = '"(?:[^"\\\\]++|\\\\.)*+"'
# Deeper values are not parsed: Spark's own functions over them call themselves for each level.
MAX_NESTING = 128


def too_nested(text: Column, most: int = MAX_NESTING) -> Column:
    """Whether brackets outside strings are nested more than ``most`` deep, found without parsing.

    Only texts with more opening brackets than that are looked at: the innermost pairs are taken away ``most`` times.
    """
    many = text.rlike(f"\\A(?:[^{{\\[]*+[{{\\[]){{{most + 1}}}")
    brackets = F.regexp_replace(F.regexp_replace(text, QUOTED, ""), "[^{}\\[\\]]+", "")
    left = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)), brackets,
        lambda s, _: F.when(s != "", F.regexp_replace(s, "\\{\\}|\\[\\]", "")).otherwise(s),
    )
    return F.when(many, left != "").otherwise(False)


def parsed(text: Column) -> Column:
    """The JSON value, NULL for malformed text, repeated keys or more than ``MAX_NESTING`` levels."""
    return F.try_parse_json(F.when(~too_nested(text), text))


def is_finite_json(text: Column) -> Column:
    """Whether no number of the value overflows a double (strings are skipped)."""
    bare = F.regexp_replace(text, QUOTED, "0")
    numbers = F.regexp_extract_all(bare, F.lit("-?[0-9][0-9.eE+-]*+"), F.lit(0))
    huge = F.exists(numbers, lambda n: F.abs(n.try_cast("double")) == float("inf"))
    # Only an exponent or a very long number can overflow; digests hold what looks like one, but begin with a quote.
    may = "(?:\\A|[\\s:,\\[])-?[0-9][0-9.]*+[eE]|[0-9]{300}"
    return ~F.when(text.rlike(may), F.coalesce(huge, F.lit(False))).otherwise(False)


def is_object(text: Column) -> Column:
    return parsed_is_object(text) & F.coalesce(is_finite_json(text), F.lit(False))


def args_hash(text: Column) -> Column:
    """Hash of the value with sorted keys and no white space."""
    return F.sha2(F.to_json(parsed(text)), 256)


def member(text: Column, name: Column | str) -> Column:
    """One member of an object as a VARIANT."""
    if isinstance(name, str):
        return F.try_variant_get(parsed(text), f"$['{name}']", "variant")
    return F.try_variant_get(parsed(text), F.concat(F.lit("$['"), name, F.lit("']")), "variant")


def _digest_member(name: str, value: Column) -> Column:
    """The compact text of a member that holds 64 hexadecimal digits, else NULL."""
    return F.when(value.rlike("^[0-9a-f]{64}\\z"), F.concat(F.lit(f'"{name}":"'), value, F.lit('"')))


def without_digest(text: Column, name: str) -> Column:
    """A compact JSON object without its own member ``name`` that holds 64 hexadecimal digits; members inside others stay.

    The text must be one that ``parsed`` reads.
    """
    def read(t: Column) -> Column:
        return let(F.struct(t.alias("t"), F.try_variant_get(F.try_parse_json(t), f"$.{name}", "string").alias("v")), found)

    def found(s: Column) -> Column:
        member = F.struct(s["t"].alias("t"), _digest_member(name, s["v"]).alias("m"))
        return let(member, lambda s: F.when(F.contains(s["t"], s["m"]), cut_out(s)).otherwise(s["t"]))

    def cut_out(s: Column) -> Column:
        return let(F.struct(s["m"].alias("m"), F.split(s["t"], s["m"], -1).alias("parts")), without)

    def without(s: Column) -> Column:
        parts, member = s["parts"], s["m"]

        def depth(i: Column) -> Column:
            bare = F.regexp_replace(F.call_function("array_join", F.slice(parts, F.lit(1), i), member), QUOTED, "")
            opened, closed = (F.length(bare) - F.length(F.translate(bare, marks, "")) for marks in ("{[", "}]"))
            return opened - closed

        # An object says each name once at its own level.
        at = F.get(F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: depth(i) == 1), F.lit(0))
        sides = F.struct(
            F.call_function("array_join", F.slice(parts, F.lit(1), at), member).alias("before"),
            F.call_function("array_join", F.slice(parts, at + 1, F.size(parts)), member).alias("after"),
        )
        return let(sides, lambda x: F.when(x["after"].startswith(","), F.concat(x["before"], F.substr(x["after"], F.lit(2)))).otherwise(
            F.concat(F.regexp_replace(x["before"], ",\\z", ""), x["after"])
        ))

    return let(text, read)


def without_known_digest(text: Column, name: str, value: Column) -> Column:
    """As ``without_digest`` for a text that ``to_json`` wrote, whose member ``name`` has been read before.

    Where the member's text stands once it is the object's own, and nothing is parsed again.
    """
    def cut_out(s: Column) -> Column:
        bare = F.replace(s["t"], s["m"], F.lit(""))
        before = F.replace(s["t"], F.concat(s["m"], F.lit(",")), F.lit(""))
        after = F.replace(s["t"], F.concat(F.lit(","), s["m"]), F.lit(""))
        once = F.when(before != s["t"], before).when(after != s["t"], after).otherwise(bare)
        several = F.length(s["t"]) - F.length(bare) > F.length(s["m"])
        return F.when(s["m"].isNull(), s["t"]).when(several, without_digest(s["t"], name)).otherwise(once)

    return let(F.struct(text.alias("t"), _digest_member(name, value).alias("m")), cut_out)


# --- leaves ------------------------------------------------------------------------------------

# A node is a part of a JSON value: the steps that lead to it (".key" or "[index]"), its JSON text (for strings what they
# say) and its kind by the first letter of its type, K for a key.
NODE = "struct<steps:array<string>,text:string,kind:string>"
# Most levels that are unrolled; what lies deeper is a fault.
MAX_LEVELS = 64


def _node(steps: Column, text: Column, kind: Column) -> Column:
    return F.struct(steps.alias("steps"), text.alias("text"), kind.alias("kind"))


def _kind_of(text: Column, value: Column) -> Column:
    """The kind of a part: a container shows by what it holds, as the whole schema of each level would cost depth times size."""
    array = text.startswith("[") & F.try_variant_get(value, "$[0]", "variant").isNotNull()
    members = text.startswith("{") & F.try_variant_get(value, "$", "map<string,variant>").isNotNull()
    return F.when(array, "A").when(members, "O").otherwise(F.left(F.schema_of_variant(value), F.lit(1)))


def _root_kind(text: Column) -> Column:
    """The kind of a whole text, NULL when it is not JSON."""
    kind = F.translate(F.substring(F.regexp_replace(text, "^\\s+", ""), 1, 1), '{["tfn', "OASTTV")
    return F.when(parsed(text).isNotNull(), F.when(kind.isin("O", "A", "S", "T", "V"), kind).otherwise("D"))


def is_open(node: Column) -> Column:
    """Whether a node holds others: an OBJECT or an ARRAY."""
    return node["kind"].isin("O", "A")


def _below(node: Column, with_keys: bool) -> Column:
    """The nodes inside a container in the order of the text; a key comes before its value."""
    steps, text = node["steps"], node["text"]

    def member(entry: Column, value: Column) -> Column:
        here = F.concat(steps, F.array(F.concat(F.lit("."), entry["key"])))
        found = _node(here, entry["value"], _kind_of(entry["value"], value))
        return F.array(_node(here, entry["key"], F.lit("K")), found) if with_keys else F.array(found)

    def item(pair: Column, i: Column) -> Column:
        here = F.concat(steps, F.array(F.concat(F.lit("["), i.cast("string"), F.lit("]"))))
        return _node(here, pair["text"], _kind_of(pair["text"], pair["value"]))

    members = F.flatten(
        F.zip_with(F.map_entries(F.from_json(text, "map<string,string>")), F.map_values(F.from_json(text, "map<string,variant>")), member)
    )
    # The only item of an array shows what it is by its first character; others are read a second time for their kinds.
    first = F.when(text.startswith("["), F.translate(F.substring(text, 2, 1), '{["', "OAS"))

    def items(texts: Column) -> Column:
        every = F.transform(F.arrays_zip(texts.alias("text"), F.from_json(text, "array<variant>").alias("value")), item)
        only = F.array(_node(F.concat(steps, F.array(F.lit("[0]"))), F.get(texts, F.lit(0)), first))
        return F.when((F.size(texts) == 1) & first.isin("O", "A", "S"), only).otherwise(every)

    return F.when(node["kind"] == "O", members).otherwise(let(F.from_json(text, "array<string>"), items))


def unrolled(nodes: Column, levels: Column | int, with_keys: bool) -> Column:
    """The nodes after opening their containers ``levels`` times, breadth-first; the order of the text is kept."""
    def level(state: Column, _: Column) -> Column:
        opened = F.flatten(F.transform(state, lambda n: F.when(is_open(n), _below(n, with_keys)).otherwise(F.array(n))))
        return F.when(F.exists(state, is_open), opened).otherwise(state)

    count = levels if isinstance(levels, Column) else F.lit(levels)
    return F.aggregate(F.sequence(F.lit(1), count), nodes, level)


def json_nodes(text: Column, with_keys: bool, levels: int = MAX_LEVELS, root_kind: Column | None = None) -> Column:
    """Keys and scalars of a JSON text in its order; a container that is left lies deeper than ``levels``.

    NULL when the text is not JSON or repeats a key. A text has no more levels than opening brackets, so flat texts are
    opened a few times only.
    """
    def opened(kind: Column) -> Column:
        said = F.when(kind == "S", F.try_variant_get(F.try_parse_json(text), "$", "string")).otherwise(text)
        root = F.array(_node(F.array().cast("array<string>"), said, kind)).cast(f"array<{NODE}>")
        brackets = F.length(text) - F.length(F.translate(text, "{[", ""))
        return F.when(kind.isNotNull(), unrolled(root, F.least(F.greatest(brackets, F.lit(1)), F.lit(levels)), with_keys))

    return let(_root_kind(text) if root_kind is None else root_kind, opened)


def path_of(steps: Column) -> Column:
    """Keys joined by dots, indexes in brackets."""
    return F.regexp_replace(F.array_join(steps, ""), "^\\.", "")


def _is_number(node: Column) -> Column:
    """BIGINT, DECIMAL, DOUBLE or FLOAT."""
    return node["kind"].isin("B", "D", "F") & node["text"].rlike("^[-0-9]")


def _leaf(node: Column, immutable: Column) -> Column:
    return F.struct(
        path_of(node["steps"]).alias("path"), node["text"].alias("text"), (node["kind"] == "K").alias("is_key"),
        immutable.alias("immutable"),
    )


def _listed(nodes: Column, mode: str) -> Column:
    """Leaves of a mode that takes whatever there is."""
    kinds = {"strings": ["S"], "scalars": ["S"], "texts": ["S", "K"]}[mode]

    def wanted(n: Column) -> Column:
        said = n["kind"].isin(*kinds)
        return said if mode == "strings" else said | _is_number(n)

    return F.transform(F.filter(nodes, wanted), lambda n: _leaf(n, n["kind"] == "K"))


# --- what a model reads of a request --------------------------------------------------------------


def _names(steps: Column) -> Column:
    """The keys among the steps."""
    return F.transform(F.filter(steps, lambda s: s.startswith(".")), lambda s: F.substr(s, F.lit(2)))


def _inside(names: Column) -> Column:
    """What the container of the last of the names holds: 'arguments', 'properties' (of a schema), 'schema' or 'free'.

    Arguments and schemas begin below a key of that name, but not a key of the request itself. Inside a schema the
    last container decides whether keys are the schema's words or names of properties.
    """
    above = F.slice(names, F.lit(2), F.greatest(F.size(names) - 2, F.lit(0)))
    entered = F.filter(above, lambda n: n.isin("arguments", "schema", "parameters"))
    return (
        F.when(F.size(entered) == 0, "free")
        .when(F.get(entered, F.lit(0)) == "arguments", "arguments")
        .when(F.get(names, F.size(names) - 2).isin(*PROPERTY_MAPS), "properties")
        .otherwise("schema")
    )


def _with_arguments(nodes: Column, levels: int) -> Column:
    """Nodes with those of argument texts, which are JSON of their own, in place of the texts; broken ones have kind X."""
    def root(n: Column) -> Column:
        call = F.array_join(_names(n["steps"]), "/").rlike("^messages/(?:tool_calls/function|function_call)/arguments\\z")
        kind = F.coalesce(F.when(is_finite_json(n["text"]), _root_kind(n["text"])), F.lit("X"))
        return F.when((n["kind"] == "S") & call, _node(n["steps"], n["text"], kind)).otherwise(n)

    opened = F.transform(nodes, root)
    return F.when(F.exists(nodes, lambda n: F.array_contains(n["steps"], ".arguments")), unrolled(opened, levels, True)).otherwise(nodes)


def _in_scope(steps: Column) -> Column:
    """Whether metadata of a request holds a place: not the request's switches, nor what messages say."""
    first = F.get(steps, F.lit(0))
    second = F.coalesce(F.get(F.filter(F.slice(steps, F.lit(2), F.lit(2)), lambda s: s.startswith(".")), F.lit(0)), F.lit(".content"))
    said = F.when(first == ".messages", second == ".content").otherwise(False)
    return ~(first.isin(*sorted("." + f for f in FLAGS)) | said)


def _request_leaves(nodes: Column) -> Column:
    """Texts and names a model reads; fixed protocol words and words of the schema language are left out."""
    def described(n: Column) -> Column:
        """A node in scope with the names above it, what holds it and whether it is an item of a list."""
        def with_area(names: Column) -> Column:
            return F.struct(
                n.alias("n"), F.size(names).alias("depth"), F.get(names, F.size(names) - 1).alias("key"),
                _inside(names).alias("area"), F.get(n["steps"], F.size(n["steps"]) - 1).startswith("[").alias("in_list"),
            )

        return let(_names(n["steps"]), with_area)

    def wanted(x: Column) -> Column:
        key, area = x["key"], x["area"]
        named = (x["depth"] > 1) & (area.isin("arguments", "properties") | ((area == "schema") & ~key.isin(*SCHEMA_KEYWORDS)))
        word = F.when(x["depth"] == 1, key.isin("tool_choice", "function_call")).when(area == "free", key.isin("role", "type")).otherwise(
            (area != "arguments") & (key == "type") & x["n"]["text"].isin(*SCHEMA_TYPES)
        )
        return F.when(x["n"]["kind"] == "K", named).otherwise(x["in_list"] | ~word)

    def fixed(x: Column) -> Column:
        """Whether a text names something and must not be rewritten."""
        return (x["n"]["kind"] == "K") | (~x["in_list"] & (x["depth"] > 1) & x["key"].isin(*IDENTIFIERS))

    said = F.filter(nodes, lambda n: n["kind"].isin("S", "K") & _in_scope(n["steps"]))
    return F.transform(F.filter(F.transform(said, described), wanted), lambda x: _leaf(x["n"], fixed(x)))


MODES = ("strings", "scalars", "texts", "metadata")


def read_leaves(text: Column, mode: str = "strings", max_depth: int | None = None) -> Column:
    """struct<leaves, fault> of a JSON text: its leaves in order, or the reason why it cannot be read (never both).

    Modes: 'strings', 'scalars' (numbers too), 'texts' (numbers and keys) and 'metadata' (what a model reads in a chat
    request besides message contents). Metadata may be nested ``MAX_DEPTH`` levels below its field or message, other texts
    ``MAX_LEVELS`` in all, unless ``max_depth`` says otherwise.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    metadata = mode == "metadata"
    most = max_depth if max_depth is not None else MAX_DEPTH if metadata else MAX_LEVELS
    # A field lies one step below the request, a message two; the container itself opens one level more.
    levels = most + 3 if metadata else most

    def field(x: Column) -> Column:
        return F.when(F.get(x["steps"], F.lit(0)) == ".messages", 2).otherwise(1)

    def deep(x: Column) -> Column:
        """Whether a node lies too deep; its steps lead through its containers, so a leaf tells how deep they are."""
        if not metadata:
            return is_open(x)
        below = F.size(x["steps"]) - field(x) - F.when(is_open(x), 0).otherwise(1) > most
        return (is_open(x) | below) & _in_scope(x["steps"])

    def judged(n: Column, kind: Column) -> Column:
        faults = [
            F.when(n.isNull(), F.when(too_nested(text), f"nested more than {min(most, MAX_NESTING)} levels").otherwise("not JSON with unique keys")),
            F.when(~is_finite_json(text), "number that is not finite"),
        ]
        if metadata:
            faults += [
                F.when(~F.coalesce(kind == "O", F.lit(False)), "not an object"),
                F.when(F.exists(n, lambda x: x["kind"] == "X"), "arguments that are not JSON"),
            ]
        faults.append(F.when(F.exists(n, deep), f"nested more than {most} levels"))
        leaves = _request_leaves(n) if metadata else _listed(n, mode)
        return let(F.coalesce(*faults), lambda f: F.struct(F.when(f.isNull(), leaves).cast(LEAF).alias("leaves"), f.alias("fault")))

    def read(kind: Column) -> Column:
        nodes = json_nodes(text, mode in ("texts", "metadata"), levels, kind)
        whole = let(nodes, lambda n: _with_arguments(n, levels)) if metadata else nodes
        return let(whole, lambda n: judged(n, kind))

    return let(_root_kind(text), read)


def parsed_is_object(text: Column) -> Column:
    return F.coalesce(_root_kind(text) == "O", F.lit(False))


def json_leaves(text: Column, mode: str = "strings", max_depth: int | None = None) -> Column:
    """array<struct<path,text,is_key,immutable>> of a JSON text, NULL when it cannot be read."""
    return read_leaves(text, mode, max_depth)["leaves"]


def explode_leaves(df: DataFrame, column: str, mode: str = "strings", *keep: str) -> DataFrame:
    """One row per leaf: the kept columns, leaf_ord, path, text, is_key, immutable, fault.

    A text that cannot be read is one row with ``fault`` and nothing else, so that what cannot be seen can be refused.
    """
    read = df.select(*keep, read_leaves(F.col(column), mode).alias("_read"))
    leaves = read.select(*keep, F.posexplode_outer("_read.leaves").alias("leaf_ord", "_leaf"), F.col("_read.fault").alias("fault"))
    return leaves.where("leaf_ord is not null or fault is not null").select(*keep, "leaf_ord", "_leaf.*", "fault")
