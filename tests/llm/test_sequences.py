"""Prefix trie, conversation repair and token files against brute force, and their edge cases."""
import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from guardtables.llm import prefix_trie, sequences, token_files, turn_repair
from guardtables.llm.line_index import shared_folder
from guardtables.llm.piece_encoding import tokenizer_path

SCHEMA = "conv_id long, turn long, role string, text string, part int, words string, place long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def made(seed: int, convs: int, longest: int) -> list[tuple]:
    """Conversations of few distinct turns, with nulls, ties, repeated rows and one long conversation."""
    random = np.random.default_rng(seed)
    texts = ["Hello there.", "What now?", "no end", "", "  \n", None, "Fine. Really!", "ünï cödé."]
    rows = []
    for conv in range(-25, convs):
        if conv % 7 == 3:
            continue
        n = longest if conv == 5 else int(random.integers(0, 7))
        for turn in range(n):
            role = ("system" if turn == 0 and conv % 3 else random.choice(["user", "assistant", "user", "assistant", "tool", "", None]))
            when = None if random.random() < 0.05 else int(turn if random.random() < 0.8 else random.integers(0, 4))
            rows.append((conv, when, role, texts[int(random.integers(0, 3 if conv % 2 else 8))], 1, "x", 2))
    rows += [rows[3], rows[3], rows[50], (None, 1, "user", "a.", 1, "x", 2), (None, None, None, None, 1, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def trie_of(rows: list[tuple]) -> dict:
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - int(np.fmod(conv, 20))
        whole = turns.get(base, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(conv)
        ends[tuple(whole)].append(conv)
    found = {}
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n)
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        found[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(convs), sum(len(n) == len(node) + 1 for n in below), leaves, saved,
            sha(",".join(map(str, sorted(ends.get(node, []))))),
        )
    return found


@pytest.mark.parametrize("part_rows, cells", [(200_000, prefix_trie.MOST_CELLS), (20, 1 << 16)])
def test_trie_equals_brute_force(spark, part_rows, cells):
    rows = made(1, 45, 60)
    found = prefix_trie.prefix_trie(frame(spark, rows), part_rows, cells).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found} == trie_of(rows)
    assert len(found) == len(trie_of(rows))


def test_trie_does_not_depend_on_the_sketch(spark, monkeypatch):
    """A sketch of very few cells sends nearly all prefixes the exact way."""
    rows = made(2, 30, 12)
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    found = prefix_trie.prefix_trie(frame(spark, rows), 15, 64).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found} == trie_of(rows)


def test_trie_of_many_equal_conversations(spark):
    """One conversation that hundreds repeat: its ends are one hashed list, in pieces."""
    rows = [(c, t, "user" if t % 2 else "system", f"turn {t}", 0, "", 0) for c in range(20, 20 * 300, 20) for t in range(6)]
    found = prefix_trie.prefix_trie(frame(spark, rows), 100).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found} == trie_of(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(frame(spark, made(1, 3, 3)).limit(0)).count() == 0


def test_running_sums_cross_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 3 == 0).cast("long").alias("g"), F.col("id").alias("v"), (F.col("id") * 2).alias("w"))
    table = sequences.ordered(rows, ["g", "v"], ["g", "v", "w"], 1000, 50)
    assert table.select("part").distinct().count() > 10
    got = sorted(tuple(r) for r in sequences.running(table, "g", ("v", "w"), 1, ["g", "v"]).collect())
    expected = []
    for g in (0, 1):
        own = [i for i in range(1000) if (i % 3 == 0) == bool(g)]
        for at, v in enumerate(own):
            expected.append((g, v, at, sum(own[:at]), 2 * sum(own[:at]), sum(own[: at + 1]), 2 * sum(own[: at + 1]), at == len(own) - 1))
    assert got == sorted(expected)


# --- repair --------------------------------------------------------------------------------------------------------------


def repaired(rows: list[tuple]) -> dict:
    """The contract by recursion over rows and states with all edits."""
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        kept = groups[conv]
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        kept += [(turn, role, text)] * (2 if hit == 3 else 1)
    return {conv: one(sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for conv, kept in groups.items()}


def one(rows: list[tuple]) -> tuple:
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip("\x20\t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i: int, so_far: str, inserted: int) -> tuple | None:
        """Cost, edits and lines from row i on; ``so_far`` is the last role's initial, or nothing."""
        options = []
        if inserted < 3:
            for role in ("user", "assistant"):
                if (role == "assistant") == (so_far == "u"):
                    rest = best(i, role[0], inserted + 1)
                    options += [(rest[0] + 3, "I" + rest[1], (role + ":",) + rest[2])] if rest else []
        if i == len(rows):
            return min(options + ([(0, "", ())] if so_far in ("", "a") else []), default=None)
        _, role, text = rows[i]
        rest = best(i + 1, so_far, 0)
        options += [(rest[0] + 4, "D" + rest[1], rest[2])] if rest else []
        if faults[i] in ("", "t"):
            extra = 3 if faults[i] else 0
            for name, edit, cost in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                fits = {"s": so_far == "", "u": so_far in ("", "s", "a"), "a": so_far == "u"}.get(name[:1], False)
                rest = best(i + 1, name[:1], 0) if fits else None
                options += [(rest[0] + cost + extra, edit + rest[1], (f"{name}:{text}",) + rest[2])] if rest else []
        return min(options, default=None)

    for i in range(len(rows), 0, -1):  # from the end, so that no call is deep
        for so_far in ("", "s", "u", "a"):
            best(i, so_far, 0)
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit, lines = best(0, "", 0)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)),
    )


@pytest.mark.parametrize("part_rows", [200_000, 12])
def test_repair_equals_brute_force(spark, part_rows):
    for seed in (1, 2):
        rows = made(seed, 40, 70)
        found = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair(frame(spark, rows), part_rows).collect()}
        assert found == repaired(rows)


def test_repair_passes(spark):
    """A conversation over many partitions: speculative vectors settle in a few passes."""
    random = np.random.default_rng(4)
    roles = ["system"] + list(random.choice(["user", "assistant"], 899))
    rows = [(1, i, r, f"text {i}.", 0, "", 0) for i, r in enumerate(roles)]
    table = frame(spark, rows)
    turns = sequences.ordered(
        turn_repair.with_symbols(turn_repair.damaged(table)), ["conv_id", "turn", "role", "text", "row_no"],
        ["conv_id", "turn", "role", "text", "symbol"], len(rows), 50,
    )
    chunks = turns.select("conv_id", "symbol", "part").mapInArrow(turn_repair._border_chunks, turn_repair.CHUNK)
    ends, begins, passes = turn_repair.linked(chunks)
    assert len(begins) > 10 and 1 <= passes <= 4
    found = turn_repair.repair(table, 50).collect()
    assert [tuple(r)[1:] for r in found] == [repaired(rows)[1]]


def test_backward_passes_are_exact():
    """Vectors of a chunk from a guess, mended from the true end, equal those of the whole."""
    random = np.random.default_rng(5)
    for _ in range(50):
        symbols = bytes(random.integers(0, 16, 300).tolist())
        cut = int(random.integers(1, 299))
        whole = turn_repair.all_vectors(symbols, turn_repair.END)
        _, marks = turn_repair.backward(symbols[:cut], turn_repair.END)
        first, mended = turn_repair.backward(symbols[:cut], whole[cut], turn_repair.decoded(turn_repair.coded(marks)))
        assert first == whole[0] and mended == [whole[i] for i in range(0, cut, turn_repair.STRIDE)] + mended[-(-cut // turn_repair.STRIDE):]


def test_repair_of_nothing(spark):
    assert turn_repair.repair(frame(spark, made(1, 3, 3)).limit(0)).count() == 0


# --- token files -----------------------------------------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "\n\t", "Hello, WORLD's  end 12345", "a\x1cb\x85c d e", "<|endoftext|> and <|startoftext|>x", "é ́a İI ΣΑΣ ς",
    "x" * 3000, "日本語 текст 😀😀 ﬁ", "it's they'll WE'RE 'tis", "​ zero ﻿", "tab\tvt\x0bff\x0ccr\rnl\n", "word " * 20_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (4, TEXTS[4], "x", 1), (4, "other", "x", 1), (-3, "first", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(3)


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    folder = shared_folder(spark, "token-files")
    token_files.write(docs, folder, path, file_bytes=50)
    assert token_files.manifest(spark, folder).count() > 1
    found = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    assert len(found) == len(TEXTS) + 4
    expected = defaultdict(list)
    for r in docs.collect():
        expected[r["doc_id"]].append([*model.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    at, last = 0, None
    for r in found:
        assert r["start"] == at and r["ids"] in expected[r["doc_id"]]
        expected[r["doc_id"]].remove(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert last is None or r["doc_id"] >= last
        at, last = at + len(r["ids"]), r["doc_id"]
    assert not any(expected.values()) and found[0]["doc_id"] is None
    wanted = spark.createDataFrame([(9,), (77,), (None,)], "doc_id long")
    assert [(r["doc_id"], r["ids"]) for r in token_files.lookup(spark, folder, wanted).collect()] == [
        (9, [*model.encode(TEXTS[9], add_special_tokens=False).ids, 1])
    ]


def test_token_files_name_their_dictionary(spark, docs, tmp_path):
    writer = token_files.FileWriter(str(tmp_path), b"some dictionary content", 2)
    writer.add(7, np.array([5, 6, 1], "<u2").tobytes())
    writer.close()
    reader = token_files.FileReader(str(tmp_path), writer.name, b"some dictionary content")
    assert reader.find(7).tolist() == [5, 6, 1] and reader.find(8) is None
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.FileReader(str(tmp_path), writer.name, b"another one")
    whole = (tmp_path / writer.name).read_bytes()
    (tmp_path / "torn.tok").write_bytes(whole[:-30])
    with pytest.raises(ValueError, match="not complete"):
        token_files.FileReader(str(tmp_path), "torn.tok", b"some dictionary content")


def test_token_files_of_nothing(spark, docs):
    folder = shared_folder(spark, "token-files")
    token_files.write(docs.limit(0), folder, tokenizer_path("word_bpe_49k.json"))
    assert token_files.read(spark, folder).count() == 0


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    model, table = Tokenizer.from_file(path), token_files.Words(path)
    random = np.random.default_rng(6)
    plain = list("abzAZéÀÖØöøÿĀįıžſАяЁё.,;:!?$&()-_/<>|@[]`{}~ ")
    letters = list("ab'stdlvemré́̇İßΣς12 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　.-!…😀\x00<|>") + ["<|endoftext|>"]
    texts = ["".join(random.choice(kind, random.integers(0, 40))) for _ in range(5000) for kind in (letters, plain)]
    flat, bounds = table.ids(pa.array([None, *texts]))
    assert bounds[1] == 0
    for text, a, b in zip(texts, bounds[1:-1], bounds[2:], strict=True):
        assert flat[a:b].tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)
