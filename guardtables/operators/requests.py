"""Chat requests and tool calls as rows: flattening, limits, identities, provenance, shape checks."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import hmac_sha256
from ..functions.expr import let
from ..functions.jsonx import explode_leaves, is_object, parsed
from ..functions.text import base64_bytes, utf8
from ..functions.windows import running_total
from .injection import score_pieces
from .views import build_views

# Fields of the supported protocol.
REQUEST_FIELDS = (
    "model messages tools tool_choice functions function_call parallel_tool_calls response_format max_tokens "
    "max_completion_tokens n temperature top_p frequency_penalty presence_penalty seed stop stream stream_options "
    "user logprobs top_logprobs logit_bias service_tier"
).split()
MESSAGE_FIELDS = "role content name tool_call_id tool_calls function_call refusal".split()
ROLES = "system developer user assistant tool function".split()
CHOICES = "auto none required".split()
FORMATS = "text json_object json_schema".split()
NUMBERS = "temperature top_p frequency_penalty presence_penalty seed top_logprobs".split()
BOOLEANS = "parallel_tool_calls stream logprobs".split()


def content_text(parts: Column) -> Column:
    """Text of a message whose content is a list of parts, joined by line breaks."""
    return F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")


def source_of(role: Column) -> Column:
    return F.when(role == "tool", "tool").when(role == "assistant", "model").otherwise("user")


def applies(configured: Column, direction: Column) -> Column:
    """Whether a control configured for a direction looks at this one."""
    return (configured == "both") | (configured == direction)


def input_size(turns: DataFrame, key: str, max_chars: int, text: str = "text") -> DataFrame:
    """Characters per request and whether they exceed the limit."""
    return (
        turns.groupBy(key)
        .agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars"))
        .withColumn("too_large", F.col("chars") > max_chars)
    )


def fingerprint(role: Column, text: Column) -> Column:
    """Hash of a message by role and text."""
    return F.sha2(F.to_json(F.array(role, text)), 256)


def session_ids(turns: DataFrame, key: str, agent: Column, order: str = "turn") -> DataFrame:
    """Default session of a request: a short hash of the agent and the first user text."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col(order)))
    got = turns.groupBy(key).agg(F.coalesce(first, F.lit("")).alias("_first"), F.min(agent).alias("agent_id"))
    digest = F.sha2(F.concat_ws("|", "agent_id", "_first"), 256)
    return got.select(key, "agent_id", F.concat(F.lit("s_"), F.left(digest, F.lit(16))).alias("session_id"))


# Characters of a piece of joined turns, and those that it shows again of the piece before. A phrase, with the words at its
# ends, is found when it takes ``OVERLAP - TOKEN`` characters or less; a longer word at a piece's end is cut.
PIECE, OVERLAP, TOKEN = 65_536, 16_384, 8_192
# Turns of one slice of a conversation.
SLICE = 1_000


def joined_chunks(turns: DataFrame, key: str, blocked: DataFrame | None = None, order: str = "turn", size: int = PIECE) -> DataFrame:
    """The user turns of each request joined by spaces, where there are several and none is blocked, as chunks.

    One row (key, at, part) for what a turn has in each stretch of ``size`` characters of the joined text; ``at`` is its
    place there. No request is gathered: places are running sums over slices of its turns. Turns are in the order of
    ``order`` (null first) and text.
    """
    users = turns.where(F.col("role") == "user").select(key, F.col(order).alias("_o"), F.coalesce("text", F.lit("")).alias("_t"))
    wanted = users.groupBy(key).agg(F.count("*").alias("_users")).where("_users > 1").select(key)
    if blocked is not None:
        wanted = wanted.join(blocked.select(key).distinct(), key, "left_anti")
    length = (F.length("_t") + 1).cast("long")
    slice_of = F.coalesce(F.floor(F.col("_o") / SLICE), F.lit(-(1 << 53)))
    placed = running_total(users.join(wanted, key, "left_semi"), [key], [F.col("_o"), F.col("_t")], length, slice_of, "_upto")
    start = F.col("_upto") - length
    # Every turn but the first brings the space before it.
    placed = placed.select(
        key, F.greatest(start - 1, F.lit(0)).alias("_begin"), F.concat(F.when(start > 0, " ").otherwise(""), "_t").alias("_t")
    )
    first = (size - F.col("_begin") % size).cast("int")
    parts = F.concat(
        F.array(F.left("_t", first)), F.regexp_extract_all(F.substr("_t", first + 1), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    )
    at = F.when(F.col("_i") == 0, F.col("_begin")).otherwise((F.floor(F.col("_begin") / size) + F.col("_i")) * size)
    return placed.select(key, "_begin", F.posexplode(parts).alias("_i", "part")).select(key, at.cast("long").alias("at"), "part")


def joined_pieces(
    turns: DataFrame, key: str, blocked: DataFrame | None = None, order: str = "turn", size: int = PIECE, overlap: int = OVERLAP,
    token: int = TOKEN,
) -> DataFrame:
    """The joined user turns in pieces (key, at, text) of bounded length that overlap by ``overlap`` characters.

    A request of less than ``size`` characters is one piece, its whole text. At an edge inside the text a piece leaves out
    the word that the edge cuts (``token`` characters of it at most).
    """
    chunks = joined_chunks(turns, key, blocked, order, size).withColumn("_n", F.floor(F.col("at") / size))
    upto = (F.col("_n") + 1) * size
    # One character more on each side tells whether a word is cut.
    early = F.greatest(upto - overlap - 1 - F.col("at"), F.lit(0)).cast("int")

    def shown(n: Column, at: Column, part: Column, core: bool, after: bool) -> Column:
        return F.struct(n.alias("n"), at.cast("long").alias("at"), part.alias("part"), F.lit(core).alias("core"), F.lit(after).alias("after"))

    at, n, part = F.col("at"), F.col("_n"), F.col("part")
    shows = F.array(
        shown(n, at, part, True, False),
        F.when(at + F.length(part) > at + early, shown(n + 1, at + early, F.substr(part, early + 1), False, False)),
        F.when((n > 0) & (at == n * size) & (part != ""), shown(n - 1, at, F.left(part, F.lit(1)), False, True)),
    )
    rows = chunks.select(key, F.explode(F.filter(shows, lambda x: x.isNotNull())).alias("s")).select(key, "s.*")
    listed = F.array_sort(F.collect_list(F.struct("at", "after", "part")))
    pieces = rows.groupBy(key, "n").agg(
        F.array_join(F.transform(listed, lambda x: x["part"]), "").alias("_raw"), F.min("at").alias("_at"),
        F.bool_or("after").alias("_after"), F.bool_or("core").alias("_core"),
    ).where("_core")
    head = F.when(F.col("_at") > 0, F.regexp_replace("_raw", f"^\\S{{1,{token}}}+", "")).otherwise(F.col("_raw"))
    tail = F.when(F.col("_after"), F.regexp_replace("_head", f"\\S{{1,{token}}}\\z", "")).otherwise(F.col("_head"))
    return pieces.withColumn("_head", head).select(
        key, (F.col("_at") + F.length("_raw") - F.length("_head")).alias("at"), tail.alias("text")
    )


def score_joined_turns(turns: DataFrame, key: str, blocked: DataFrame | None = None, order: str = "turn", **sizes: int) -> DataFrame:
    """Injection score of the joined user turns (key, injection); other detectors have seen the turns already.

    Conversations are scanned in pieces of bounded length, each within its own decode budget.
    """
    return score_pieces(build_views(joined_pieces(turns, key, blocked, order, **sizes)), key)


def joined_digests(turns: DataFrame, key: str, blocked: DataFrame | None = None, order: str = "turn") -> DataFrame:
    """MD5 of the joined user turns (key, joined_md5): chunks pass as a stream, so memory does not grow with a request."""
    chunks = joined_chunks(turns, key, blocked, order).select(key, "at", "part")
    kind = turns.schema[key].dataType.simpleString()
    in_order = chunks.repartition(key).sortWithinPartitions(key, "at", F.length("part"))
    return in_order.mapInPandas(_md5_of_runs, f"{key} {kind}, joined_md5 string")


def _md5_of_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, state, names = None, None, None
    for frame in frames:
        names = [frame.columns[0], "joined_md5"]
        done = []
        for value, part in zip(frame.iloc[:, 0].tolist(), frame["part"]):
            if state is None or value != current:
                if state is not None:
                    done.append((current, state.hexdigest()))
                current, state = value, hashlib.md5(usedforsecurity=False)
            state.update(part.encode())
        if done:
            yield pd.DataFrame(done, columns=names)
    if state is not None:
        yield pd.DataFrame([(current, state.hexdigest())], columns=names)


def metadata_texts(requests: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Every text and name in a request, besides message contents, that a model reads.

    A body that cannot be read is one row with ``fault``; it should be refused.
    """
    return explode_leaves(requests, body, "metadata", key).where("text <> '' or fault is not null")


def label_results(results: DataFrame, tools: DataFrame) -> DataFrame:
    """Add the labels of a tool result; 'untrusted' when the tool or its provenance is not known.

    ``results`` has tool and verified (boolean).
    """
    known = tools.select("tool", F.col("labels").alias("_labels"))
    labels = F.coalesce("_labels", F.array(F.lit("untrusted")))
    return (
        results.join(known, "tool", "left")
        .withColumn(
            "labels",
            F.when(F.coalesce("verified", F.lit(False)), labels).otherwise(
                F.array_union(labels, F.array(F.lit("untrusted")))
            ),
        )
        .drop("_labels")
    )


def sign_call(raw: Column, tool: Column, session: Column, agent: Column, content: Column, key: bytes) -> Column:
    """Provenance token over the call, for logs that carry none."""
    body = F.to_json(F.array(raw, tool, session, agent, hmac_sha256(key, content)))
    payload = F.regexp_replace(F.translate(F.base64(F.encode(body, "UTF-8")), "+/", "-_"), "[=\\s]", "")
    return let(payload, lambda p: F.concat_ws(".", F.lit("call_w"), p, hmac_sha256(key, p)))


def verified_tool(token: Column, key: bytes, agent: Column, session: Column, content: Column) -> Column:
    """The tool a provenance token was issued for, NULL when the token is forged or for something else."""
    parts = F.split(token, "\\.")

    def check(p: Column) -> Column:
        payload = F.get(p, F.lit(1))
        fields = F.from_json(utf8(base64_bytes(payload)), "array<string>")
        return let(
            fields,
            lambda f: F.when(
                (F.size(p) == 3)
                & (F.get(p, F.lit(0)) == "call_w")
                & payload.rlike("^[A-Za-z0-9_-]+\\z")
                & (F.get(p, F.lit(2)) == hmac_sha256(key, payload))
                & (F.size(f) == 5)
                & (F.get(f, F.lit(1)) != "")
                & (F.get(f, F.lit(2)) == session)
                & (F.get(f, F.lit(3)) == agent)
                & (F.get(f, F.lit(4)) == hmac_sha256(key, content)),
                F.get(f, F.lit(1)),
            ),
        )

    return F.when(F.length(token) <= 16384, let(parts, check))


# --- shape checks ----------------------------------------------------------------------------


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("ABSENT"))


def _is(value: Column, *kinds: str) -> Column:
    """Whether a VARIANT has one of the types (by the start of its schema)."""
    hit = F.lit(False)
    for kind in kinds:
        hit = hit | _kind(value).startswith(kind)
    return hit


_NUMERIC = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def _array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _get(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _extra_fields(value: Column, allowed: list[str]) -> Column:
    keys = F.json_object_keys(F.to_json(value))
    return ~_is(value, "OBJECT") | (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0)


def _text(value: Column) -> Column:
    """Whether a VARIANT is nonempty text."""
    return _is(value, "STRING") & (F.try_variant_get(value, "$", "string") != "")


def _bad_function(value: Column, call: bool) -> Column:
    allowed = ["name", "arguments"] if call else ["name", "description", "parameters", "strict"]
    bad = _extra_fields(value, allowed) | ~_text(_get(value, "name"))
    if call:
        raw = F.try_variant_get(value, "$.arguments", "string")
        return bad | ~_is(_get(value, "arguments"), "STRING") | ~is_object(raw)
    return (
        bad
        | ~_is(_get(value, "description"), "STRING", "ABSENT")
        | ~_is(_get(value, "parameters"), "OBJECT", "ABSENT")
        | ~_is(_get(value, "strict"), "BOOLEAN", "ABSENT")
    )


def _bad_message(m: Column) -> Column:
    """Names of what is wrong with one message."""
    role = F.try_variant_get(m, "$.role", "string")
    content, calls = _get(m, "content"), _get(m, "tool_calls")
    bad_part = F.exists(
        _array(content),
        lambda p: ~_is(p, "STRING")
        & (
            _extra_fields(p, ["type", "text"])
            | (F.coalesce(F.try_variant_get(p, "$.type", "string"), F.lit("")) != "text")
            | ~_is(_get(p, "text"), "STRING")
        ),
    )
    bad_call = F.exists(
        _array(calls),
        lambda c: _extra_fields(c, ["id", "type", "function"])
        | ~_text(_get(c, "id"))
        | (F.coalesce(F.try_variant_get(c, "$.type", "string"), F.lit("")) != "function")
        | _bad_function(_get(c, "function"), call=True),
    )
    faults = {
        "message fields": _extra_fields(m, MESSAGE_FIELDS),
        "message role": ~F.coalesce(role.isin(ROLES), F.lit(False)),
        "message content": ~_is(content, "STRING", "ARRAY", "VOID", "ABSENT")
        | F.coalesce(bad_part, F.lit(False)),
        "message name": (_kind(_get(m, "name")) != "ABSENT") & ~_text(_get(m, "name")),
        "message tool_call_id": (_kind(_get(m, "tool_call_id")) != "ABSENT") & ~_text(_get(m, "tool_call_id")),
        "message refusal": ~_is(_get(m, "refusal"), "STRING", "VOID", "ABSENT"),
        "message tool_calls": (_kind(calls) != "ABSENT")
        & (
            (F.coalesce(role, F.lit("")) != "assistant")
            | ~_is(calls, "ARRAY")
            | (F.coalesce(F.size(_array(calls)), F.lit(0)) < 1)
            | F.coalesce(bad_call, F.lit(False))
        ),
        "message function_call": (_kind(_get(m, "function_call")) != "ABSENT")
        & ((F.coalesce(role, F.lit("")) != "assistant") | _bad_function(_get(m, "function_call"), call=True)),
    }
    return F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in faults.items()]),
        lambda e: e.isNotNull(),
    )


def check_requests(df: DataFrame, body: str = "body", out: str = "reject_reasons") -> DataFrame:
    """Add the reasons a request body does not follow the protocol (empty when it does)."""
    v = parsed(F.col(body))
    df = df.withColumn("_v", F.when(is_object(F.col(body)), v))
    v = F.col("_v")

    def field(name: str) -> Column:
        return _get(v, name)

    def present(name: str) -> Column:
        return _kind(field(name)) != "ABSENT"

    def choice(name: str) -> Column:
        item = field(name)
        inner = _get(item, "function") if name == "tool_choice" else item
        wrong = _extra_fields(inner, ["name"]) | ~_text(_get(inner, "name"))
        if name == "tool_choice":
            wrong = wrong | _extra_fields(item, ["type", "function"]) | (
                F.coalesce(F.try_variant_get(item, "$.type", "string"), F.lit("")) != "function"
            )
        literal = F.try_variant_get(item, "$", "string")
        return F.when(_is(item, "STRING"), ~literal.isin(CHOICES)).otherwise(wrong)

    limits = ["max_tokens", "max_completion_tokens"]

    def positive_int(name: str) -> Column:
        value = F.try_variant_get(field(name), "$", "bigint")
        return _is(field(name), "BIGINT") & (value > 0)

    fmt = field("response_format")
    kind, schema = F.try_variant_get(fmt, "$.type", "string"), _get(fmt, "json_schema")
    bad_format = (
        _extra_fields(fmt, ["type", "json_schema"])
        | ~F.coalesce(kind.isin(FORMATS), F.lit(False))
        | ((kind == "json_schema") != (_kind(schema) != "ABSENT"))
        | (
            (_kind(schema) != "ABSENT")
            & (
                _extra_fields(schema, ["name", "description", "schema", "strict"])
                | ~_text(_get(schema, "name"))
                | ~_is(_get(schema, "description"), "STRING", "ABSENT")
                | ~_is(_get(schema, "strict"), "BOOLEAN", "ABSENT")
                | ~_is(_get(schema, "schema"), "OBJECT")
            )
        )
    )
    bad_tool = F.exists(
        _array(field("tools")),
        lambda t: _extra_fields(t, ["type", "function"])
        | (F.coalesce(F.try_variant_get(t, "$.type", "string"), F.lit("")) != "function")
        | _bad_function(_get(t, "function"), call=False),
    )
    bad_item = F.exists(_array(field("functions")), lambda t: _bad_function(t, call=False))
    options = field("stream_options")
    faults = {
        "request fields": _extra_fields(v, REQUEST_FIELDS),
        "model": ~_text(field("model")),
        "messages": ~_is(field("messages"), "ARRAY") | (F.coalesce(F.size(_array(field("messages"))), F.lit(0)) < 1),
        "n must be 1": present("n")
        & ~(_is(field("n"), "BIGINT") & (F.try_variant_get(field("n"), "$", "bigint") == 1)),
        "one output limit": present(limits[0]) & present(limits[1]),
        "output limit": (present(limits[0]) & ~positive_int(limits[0])) | (present(limits[1]) & ~positive_int(limits[1])),
        "tools": present("tools") & (~_is(field("tools"), "ARRAY") | bad_tool),
        "functions": present("functions") & (~_is(field("functions"), "ARRAY") | bad_item),
        "tool_choice": present("tool_choice") & choice("tool_choice"),
        "function_call": present("function_call") & choice("function_call"),
        "response_format": present("response_format") & bad_format,
        "stream_options": present("stream_options")
        & (
            _extra_fields(options, ["include_usage"])
            | ~_is(_get(options, "include_usage"), "BOOLEAN", "ABSENT")
        ),
        "stop": present("stop")
        & ~(
            _is(field("stop"), "STRING")
            | (_is(field("stop"), "ARRAY") & F.forall(_array(field("stop")), lambda s: _is(s, "STRING")))
        ),
        "logit_bias": present("logit_bias") & ~_is(field("logit_bias"), "OBJECT"),
        **{name: present(name) & ~_is(field(name), "BOOLEAN") for name in BOOLEANS},
        **{name: present(name) & ~_is(field(name), *_NUMERIC) for name in NUMBERS},
        **{name: present(name) & ~_is(field(name), "STRING") for name in ("user", "service_tier")},
    }
    top = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in faults.items()]),
        lambda e: e.isNotNull(),
    )
    messages = F.array_distinct(F.flatten(F.transform(_array(field("messages")), _bad_message)))
    reasons = F.when(v.isNull(), F.array(F.lit("not a JSON object with unique keys and finite numbers"))).otherwise(
        F.concat(top, F.coalesce(messages, F.array().cast("array<string>")))
    )
    return df.withColumn(out, reasons).drop("_v")
