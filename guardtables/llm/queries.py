"""The registered queries of this package and, where SQL can give the result, the SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, table
from . import (
    binary_codes, decontaminate, language, line_index, page_template, piece_encoding, prefix_trie, suffix_blocks, suffix_tree,
    token_files, toxicity, turn_repair, weighted_minhash,
)
from .common import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        QUERIES[name] = configured
        if sql:
            ORACLES[name] = sql
        return run

    return add


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@query("op4_piece_encoding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_encoding.encode(table(spark, sf_dir, "documents"), piece_encoding.tokenizer_path())
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.where(remainder("doc_id", 4) != 2))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder("doc_id", 5) != 0)
    found = toxicity.toxicity(docs, labels)
    return found.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op9_line_index",
    f"""
    with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    numbered as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from docs),
    keyed as (
        select *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') as key from numbered
    ),
    common as (
        select key, max(doc_id) as max_doc from keyed where length(key) >= 40
        group by key having count(distinct doc_id) >= 5
    ),
    judged as (
        select k.*, c.key is not null and k.doc_id <> c.max_doc as dropped from keyed k left join common c using (key)
    )
    select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
        sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
    from judged group by doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = line_index.LineIndex(spark, line_index.shared_folder(spark, "line-index")).insert(docs)
    kept = index.drop_repeated(docs.select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", sha256(F.col("kept")).alias("kept_sha256"))


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_binary_codes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.vector_links(table(spark, sf_dir, "embeddings"))


@query("op5_suffix_blocks")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_blocks.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", sha256(F.col("kept")).alias("kept_sha256"))


@query("op1_suffix_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


@query("op2_page_template")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_template.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(
        "row.page_id", "row.url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars")
    )


# crc32 of ASCII texts: the table by its rule, then one step for each character.
_CRC = """
crc_table as (
    select list_transform(range(256), lambda i: list_reduce(
        list_prepend(i, [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, x: xor(v >> 1, 3988292384 * (v & 1)))) as crcs
)
"""


def _crc(text: str) -> str:
    chars = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::bigint, {chars}), "
        "lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295)"
    )


@query(
    "op11_prefix_trie",
    f"""
    with {_CRC},
    turns as (
        select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
            row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place
        from conversations where conv_id is not null
    ),
    ids as (
        select conv_id, conv_id - conv_id % 20 as base, {_crc("conv_id::varchar")} % 4 as h
        from (select distinct conv_id from turns), crc_table
    ),
    joined as (
        select i.conv_id, 0 as source, t.place, t.role, t.text from ids i join turns t on t.conv_id = i.base where t.place < h
        union all
        select i.conv_id, 1, t.place, t.role, t.text from ids i join turns t on t.conv_id = i.conv_id where t.place >= h
    ),
    rebuilt as (
        select conv_id, row_number() over (partition by conv_id order by source, place) as depth,
            sha256(length(role) || ':' || role || text) as turn,
            len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words
        from joined
    ),
    rows as (
        select conv_id, depth, string_agg(turn, '') over (partition by conv_id order by depth) as prefix, words,
            depth = max(depth) over (partition by conv_id) as is_last
        from rebuilt
        union all
        select conv_id, 0, '', 0, conv_id not in (select conv_id from rebuilt) from ids
    ),
    nodes as (
        select prefix, min(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, min(words) as words,
            left(prefix, greatest(length(prefix) - 64, 0)) as above,
            sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where is_last), '')) as ends_sha256
        from rows group by prefix
    ),
    children as (select above, count(*) as n from nodes where depth > 0 group by above),
    counted as (
        select n.*, coalesce(c.n, 0) as n_children from nodes n left join children c on c.above = n.prefix
    ),
    below as (
        select a.prefix, sum((b.n_children = 0)::int) as n_leaves, sum((b.n_convs - 1) * b.words) as saved_tokens
        from counted a join counted b on starts_with(b.prefix, a.prefix) group by a.prefix
    )
    select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, b.n_leaves::bigint as n_leaves,
        b.saved_tokens::bigint as saved_tokens, c.ends_sha256
    from counted c join below b using (prefix) left join counted p on c.depth > 0 and p.prefix = c.above
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def _cheapest(*options: str) -> str:
    """The least of costs (ten digits) followed by edits and repaired lines, as structs."""
    return f"list_sort([{', '.join(options)}])[1]"


def _edit(after: str, cost: str, edit: str, line: str) -> str:
    return (
        f"{{'k': lpad((left({after}.k, 10)::int + {cost})::varchar, 10, '0') || '{edit}' || substr({after}.k, 11), "
        f"'r': {line} || {after}.r}}"
    )


def _row_options(state: int) -> str:
    """Cheapest way from a state over one row, without insertions before it."""
    wanted, role = (3, "assistant") if state == 2 else (2, "user")
    extra = "(case when fault = 3 then 3 else 0 end)"
    never = "{'k': '9999999999', 'r': ''}"
    follows = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    kept = [
        f"case when left(role, 1) = '{i}' and fault in (0, 3) then "
        f"{_edit(f'c{to}', extra, 'K', "chr(10) || role || ':' || text")} else {never} end" for i, to in follows.items()
    ]
    rerole = (
        f"case when fault in (0, 3) then "
        f"{_edit(f'c{wanted}', f'3 + {extra}', 'R', f"chr(10) || '{role}:' || text")} else {never} end"
    )
    return _cheapest(_edit(f"c{state}", "4", "D", "''"), rerole, *kept)


def _inserted(state: int, name: str, others: str) -> str:
    wanted, role = (3, "assistant") if state == 2 else (2, "user")
    return _cheapest(f"{name}{state}", _edit(f"{others}{wanted}", "3", "I", f"chr(10) || '{role}:'"))


def _columns(make) -> str:
    return ", ".join(make(state) for state in range(4))


@query(
    "op12_turn_repair",
    f"""
    with recursive {_CRC},
    hit as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as h
        from conversations, crc_table
    ),
    damaged as (
        select conv_id, turn, case when h = 4 then 'user' else role end as role,
            case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
            unnest(case when h = 3 then [0, 1] else [0] end) as copy
        from hit where h <> 0
    ),
    numbered as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from damaged
    ),
    faulty as (
        select conv_id, turn, role, text, i,
            case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1
                when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
                when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault,
            lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
        from numbered
    ),
    counts as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, max(i) as n,
            count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate,
            count(*) filter (where fault = 3) as truncated,
            count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal
        from faulty group by conv_id
    ),
    chain as (
        select conv_id, n as i, {{'k': '0000000000', 'r': ''}} as c0,
            {{'k': '0000000006II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} as c1,
            {{'k': '0000000003I', 'r': chr(10) || 'assistant:'}} as c2, {{'k': '0000000000', 'r': ''}} as c3
        from counts
        union all
        select conv_id, i, {_columns(lambda s: f"{_inserted(s, 'b', 'd')} as c{s}")} from (
            select conv_id, i, {_columns(lambda s: f'b{s}')}, {_columns(lambda s: f"{_inserted(s, 'b', 'b')} as d{s}")} from (
                select c.conv_id, c.i - 1 as i, {_columns(lambda s: f"{_row_options(s)} as b{s}")}
                from chain c join faulty f on f.conv_id is not distinct from c.conv_id and f.i = c.i where c.i >= 1
            )
        )
    ),
    found as (
        select conv_id, left(c0.k, 10)::bigint as cost, substr(c0.k, 11) as audit, substr(c0.r, 2) as repaired
        from chain where i = 0
    )
    select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
        coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
        coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
    from (select distinct conv_id from conversations) o
    left join counts c on c.conv_id is not distinct from o.conv_id
    left join found f on f.conv_id is not distinct from o.conv_id
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


@query("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = line_index.shared_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, piece_encoding.tokenizer_path("word_bpe_49k.json"))
    found = token_files.read(spark, folder)
    return found.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32")
