"""The training-data operators against brute force, and their edge cases."""
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from guardtables.llm import (
    binary_codes, common, decontaminate, language, line_index, page_template, piece_encoding, suffix_blocks, suffix_tree,
    toxicity, weighted_minhash,
)
from guardtables.llm.common import remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, keys string"
ENGLISH = "the quick brown fox jumps over the lazy dog and then the farmer went home with all of his sheep "
GERMAN = "der schnelle braune fuchs springt und dann ging der bauer mit allen seinen schafen nach hause zu "
LINE = "All rights reserved, see the licence file for more details."


def prose(seed: int, n: int = 80) -> str:
    random = np.random.default_rng(seed)
    return " ".join("".join(random.choice(list("abcdefghij"), random.integers(2, 9))) for _ in range(n))


BASE = prose(1, 120)
EDITED = BASE.replace(BASE.split()[60], "changed", 1)
TEXTS = [
    None, "", " ", "\n", "\t \n", "12 34 !!", "a", ENGLISH * 3, GERMAN * 3, ENGLISH * 3, BASE, BASE, EDITED, prose(2),
    "x" * 5000, prose(3, 20_000), "é\x00ö ﬁ 😀 ▁x  y", BASE[:260] + prose(4) + BASE[:260],
    *(f"{prose(10 + i)}\n{'  ' if i % 2 else ''}{LINE.upper() if i % 3 else LINE}\nshort" for i in range(6)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("de" if t and t.startswith("der") else "en"), None, None, "r", 1.0, "k") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, None, None, None), rows[7]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_pieces_equal_the_library(docs, nothing):
    import sentencepiece

    path = piece_encoding.tokenizer_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = piece_encoding.encode(docs, path).collect()
    assert len(found) == len(TEXTS) + 2
    for row in found:
        text = ("no id" if row.doc_id is None else TEXTS[row.doc_id]) or ""
        assert row.ids == model.encode(text) and row.decoded == model.decode(row.ids)
    assert piece_encoding.encode(nothing, path).count() == 0


def lines_by_hand(texts: dict, n: int = 5) -> dict:
    holders = defaultdict(set)

    def key(line):
        bare = line.strip(" \t\n\x0b\x0c\r")
        return bare.encode().lower() if len(bare) >= 40 else None

    for i, t in texts.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) is None or len(holders[key(x)]) < n or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def lines_of(index, frame) -> dict:
    rows = index.drop_repeated(frame).where("row.doc_id is not null").collect()
    return {r.row.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in rows}


def test_lines_and_reversal(spark, docs, nothing):
    index = line_index.LineIndex(spark, line_index.shared_folder(spark, "lines")).insert(docs)
    texts = dict(enumerate(TEXTS))
    want = lines_by_hand(texts)
    assert lines_of(index, docs) == want and sum(w[1] for w in want.values()) == 5
    # Two holders fewer: the line stays everywhere; inserted again it goes as before.
    gone = docs.where(f"doc_id in ({len(TEXTS) - 1}, {len(TEXTS) - 2})")
    index.delete(gone)
    left = {i: t for i, t in texts.items() if i < len(TEXTS) - 2}
    assert lines_of(index, docs.where(f"doc_id < {len(TEXTS) - 2}")) == lines_by_hand(left)
    assert index.table("filters").selectExpr("sum(n_keys)").first()[0] == 0
    index.insert(gone)
    assert lines_of(index, docs) == want
    empty = line_index.LineIndex(spark, line_index.shared_folder(spark, "lines")).insert(nothing)
    assert empty.drop_repeated(nothing).count() == 0


def test_cuckoo_filter_keeps_deletes_and_grows():
    keys = np.random.default_rng(5).integers(0, 256, (5000, 16), dtype=np.uint8)
    held = line_index.CuckooFilter.for_keys(keys)
    assert held.contains(keys).all()
    again = line_index.CuckooFilter.from_bytes(held.to_bytes())
    again.delete(keys[:2000])
    assert again.contains(keys[2000:]).all() and again.contains(keys[:2000]).mean() < 0.01
    assert not line_index.CuckooFilter(1).insert(keys)


def test_language(docs, nothing):
    found = {r.doc_id: r for r in language.identify(docs, docs.where("doc_id in (7, 8, 9)")).collect()}
    assert found[7].lang_pred == "en" and found[8].lang_pred == "de"
    for i in (0, 1, 2, 3, 4, 5):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(nothing, docs).count() == 0


def test_language_distance_by_hand():
    texts = {"en": ENGLISH, "de": GERMAN}
    rows = [(lang, int(g), i) for lang, t in texts.items() for i, g in enumerate(language.top(language.grams(t), 50))]
    ranks = language.Ranks(rows, 50)

    def profile(text):
        padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        runs = Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
        runs = {g: c for g, c in runs.items() if g != " " and " " not in g[1:-1]}
        code = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
        return [g for g, _ in sorted(runs.items(), key=lambda x: (-x[1], code(x[0])))][:50]

    own = profile("the bauer and the schafe")
    apart = {
        lang: sum(abs(i - profile(t).index(g)) if g in profile(t) else 50 for i, g in enumerate(own))
        for lang, t in texts.items()
    }
    best = min(sorted(apart), key=apart.get)
    assert ranks.closest("the bauer and the schafe") == (best, pytest.approx(1 - apart[best] / (50 * len(own))))


def test_toxicity_separates_held_out(spark, nothing):
    rows = [(i, prose(i) + (" you idiot " if i % 3 == 0 else " ") + prose(900 + i), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 60] + [(0, None), (999, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert sum((found[i] >= 0.5) == bool(t) for i, _, t in rows if i >= 60) >= 28
    assert found[500] == found[501] < 0.5
    assert all(r.score < 0.5 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_toxicity_equals_a_plain_reckoning(spark):
    """Scores from the lengths of windows that are cut and compressed one by one."""
    import zstandard

    rows = [(i, prose(i) + (" réeuxon réeuxpa achlichte worthless" * 2 if i % 4 == 0 else " réeuxon") + " " + prose(500 + i), int(i % 4 == 0)) for i in range(80)]
    edge = [(100, None), (101, ""), (None, "worthless réeuxon " * 9), (102, "worthless réeuxon " * 9), (102, "worthless réeuxon " * 9), (103, prose(3, 30_000)), (104, "x" * 500)]
    texts = spark.createDataFrame([r[:2] for r in rows] + edge, "doc_id long, text string")
    crowded = texts.withColumn("score", F.lit("s")).withColumn("toxic", F.lit(3)).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = [(r.doc_id, r.score) for r in toxicity.toxicity(crowded, labels).collect()]
    model = toxicity.fit(*toxicity.sample(texts, labels))
    assert b" achlicht" in model.toxic and b" achlicht" not in model.ordinary
    raw = zstandard.DICT_TYPE_RAWCONTENT

    def length(window: bytes, content: bytes) -> int:
        held = zstandard.ZstdCompressionDict(content, dict_type=raw)
        held.precompute_compress(level=toxicity.LEVEL)
        one = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)
        return len(one.compress(window))

    def plain(text):
        cut, line = [], b""
        for word in (text or "").lower().encode().split():
            if line and len(line) + len(word) + 1 > toxicity.WINDOW:
                cut, line = cut + [line], b""
            line += (b" " if line else b"") + word
        cut += [line] if line else []
        saved = sum(max(0, length(b" " + w, model.ordinary) - length(b" " + w, model.toxic)) for w in cut)
        return 1 / (1 + math.exp(-max(-50, min(50, model.steepness * (saved / (len(cut) + toxicity.PRIOR) - model.threshold)))))

    texts_of = [r[:2] for r in rows] + edge
    for i, text in texts_of[::9] + edge[:5] + edge[6:]:
        mine = {score for d, score in found if d == i}
        assert len(mine) == 1 and abs(mine.pop() - plain(text)) < 1e-9
    assert len(found) == len(texts_of) and sum((s >= 0.5) == (d % 4 == 0) for d, s in found if d is not None and d < 80) >= 78
    assert [s >= 0.5 for d, s in found if d is None or d == 102] == [True] * 3 and not any(s >= 0.5 for d, s in found if d in (100, 101, 103, 104))


def test_telling_beginnings():
    toxic = [prose(i, 40) + " scum achlichte achlichheit" for i in range(30)]
    ordinary = [prose(90 + i, 40) + (" achlich" if i == 3 else "") for i in range(60)]
    kept = toxicity.telling(toxic, ordinary)
    assert b" scum " in kept and any(x.startswith(b" achlich") for x in kept) and len(kept) <= 4
    assert toxicity.telling(toxic, toxic) == set()


def test_decontamination(spark, docs, nothing):
    item, short = " ".join(BASE.split()[30:70]), "just three words"
    items = [(1, item), (2, item.upper()), (3, short), (4, None), (5, ""), (6, prose(77, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame([(100, prose(5) + " Just, three words! " + prose(6)), (101, "three words just")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs.select("doc_id", "text").union(more), bench).collect()}
    want = {(d, i) for d in (10, 11) for i in (1, 2)} | {(100, 3)}
    assert {k for k, r in found.items() if r.similarity == 1} == want
    assert found[10, 1].first_word == 30 and found[10, 1].n_words == 40
    assert all(r.similarity >= 0.8 for r in found.values())
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_fingerprints_within_the_radius_are_all_candidates():
    items = decontaminate.Items([(i, prose(i, 30)) for i in range(20)])
    random = np.random.default_rng(3)
    prints = []
    for i in range(20):
        bits = np.unpackbits(items.prints[i])
        bits[random.choice(128, decontaminate.RADIUS, replace=False)] ^= 1
        prints.append(np.packbits(bits))
    rows, found = items.candidates(30, np.array(prints))
    assert {(i, i) for i in range(20)} <= set(zip(rows.tolist(), found.tolist(), strict=True))


def classes_by_hand(texts: dict, floor: float = weighted_minhash.FLOOR) -> dict:
    words = {i: "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "").lower()).split() for i, t in texts.items()}
    sets = {i: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, w in words.items() if w}
    held = Counter(s for c in sets.values() for s in c)
    n = len(texts)
    weigh = lambda s: 1 + math.log(n / max(1.0, floor * n, held[s] if held[s] >= max(2, floor * n) else 0))
    root = {i: i for i in texts}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in sets:
        for j in sets:
            if i < j:
                keys = set(sets[i]) | set(sets[j])
                low = sum(min(sets[i][s], sets[j][s]) * weigh(s) for s in keys)
                high = sum(max(sets[i][s], sets[j][s]) * weigh(s) for s in keys)
                if low / high >= 0.8 - 1e-12 and top(i) != top(j):
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    return {i: top(i) for i in texts}


def test_near_duplicates(spark, nothing):
    texts = dict(enumerate(TEXTS))
    for k in range(12):  # near copies of one text, each with changes of its own
        w = prose(50, 100).split()
        for at in np.random.default_rng(k).choice(100, k % 4, replace=False):
            w[at] = f"new{k}"
        texts[200 + k] = " ".join(w)
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, rep string")
    found = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(rows).collect()}
    assert found == classes_by_hand(texts)
    assert found[12] == 10 and found[0] == 0 and found[1] == 1
    assert weighted_minhash.near_duplicates(nothing).count() == 0


def test_rare_shingles_weigh_by_their_own_frequency(spark, monkeypatch):
    """Similarities by true document frequencies, also of shingles that few of many documents hold, over several blocks and shards."""
    monkeypatch.setattr(weighted_minhash, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(weighted_minhash, "SHARD_BYTES", 8000)
    one = prose(70, 60).split()
    texts = {0: " ".join(one), 1: " ".join([*one[:-1], "other"]), 2: " ".join([*one[:-1], "third", "word"])}
    texts |= {10 + i: prose(1000 + i, 6) for i in range(800)}
    sets = {i: Counter(tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)) for i, t in texts.items()}
    held = Counter(s for c in sets.values() for s in c)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    members, links = weighted_minhash.near_links(frame)
    found = {(min(r.v, r.u), max(r.v, r.u)): r.similarity for r in links.collect()}
    assert members.count() == len(texts) and len(found) >= 2 and {i for pair in found for i in pair} == {0, 1, 2}
    for (i, j), similarity in found.items():
        weight = {s: 1 + math.log(len(texts) / held[s]) for s in set(sets[i]) | set(sets[j])}
        low = sum(min(sets[i][s], sets[j][s]) * w for s, w in weight.items())
        assert similarity == pytest.approx(low / sum(max(sets[i][s], sets[j][s]) * w for s, w in weight.items()))


def test_near_copies_in_a_large_group(spark):
    """Many copies with changes of their own do not make what they share weigh less than the changes; a common passage stays common."""
    base, passage, texts = prose(90, 200).split(), prose(91, 104).split(), {}
    for k in range(60):
        w = list(base)
        for at in (20 + k, 100 + k, 190 - k // 3):
            w[at] = f"new{k}"
        texts[k] = " ".join(w if k else base)
        texts[100 + k] = " ".join([*passage, *prose(5000 + k, 12).split()])
    texts |= {1000 + i: prose(2000 + i, 8) for i in range(340)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {i for i, c in classes_by_hand(texts).items() if c == 0} == {0}
    found = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(frame).collect()}
    assert {i for i, c in found.items() if c == 0} == set(range(60))
    assert all(c == i for i, c in found.items() if i >= 100)


def removed_by_hand(texts: list[bytes]) -> list[np.ndarray]:
    places = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - 199):
            places[t[i : i + 200]].append((d, i))
    covered = [np.zeros(len(t), bool) for t in texts]
    for spots in places.values():
        for d, i in spots if len(spots) > 1 else ():
            covered[d][i : i + 200] = True
    return covered


@pytest.mark.parametrize("rows", [1, 2048])
def test_repeated_strings(spark, docs, nothing, monkeypatch, rows):
    monkeypatch.setattr(suffix_blocks, "BUCKET_ROWS", rows)
    frame = docs.where("doc_id is not null and doc_id not in (15)").dropDuplicates(["doc_id"])
    ids = sorted(r.doc_id for r in frame.select("doc_id").collect())
    texts = [(TEXTS[i] or "").encode() for i in ids]
    found = {r.row.doc_id: r for r in suffix_blocks.remove_repeats(frame).collect()}
    for i, t, cover in zip(ids, texts, removed_by_hand(texts), strict=True):
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans) == (len(t), int(cover.sum()), runs)
        assert hashlib.sha256(bytes(found[i].kept)).digest() == hashlib.sha256(kept).digest()
    assert suffix_blocks.remove_repeats(nothing).count() == 0
    twice = docs.where("doc_id = 7").collect()  # rows alike are copies of each other
    assert len(twice) == 2 and all(r.n_removed == r.n_bytes for r in suffix_blocks.remove_repeats(docs.where("doc_id = 7")).collect())


def test_difference_cover():
    cover = set(suffix_blocks.COVER.tolist())
    assert {(a - b) % suffix_blocks.PERIOD for a in cover for b in cover} == set(range(suffix_blocks.PERIOD))


def test_tree_scores(spark, docs, nothing):
    rows = suffix_tree.scores(docs, remainder("doc_id", 10) == 0, share=1e-3).collect()
    assert len(rows) == len(TEXTS) + 2
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    everything = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, TEXTS[7])]
    train = [(t or "").encode().lower().split() for i, t in everything if not held(i)]
    counts, ends = Counter(w for t in train for w in t), len(train)
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    for r in rows:
        text = ("no id" if r.doc_id is None else TEXTS[r.doc_id]) or ""
        tokens = [counts[w] for w in text.encode().lower().split()] + [ends]
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in tokens)
        assert (r.held_out, r.n_tokens, r.n_known) == (held(r.doc_id), len(tokens), sum(c > 0 for c in tokens))
        assert r.train_tokens == total and r.base_score == pytest.approx(base) and r.score < 0
    assert suffix_tree.scores(nothing, remainder("doc_id", 10) == 0).count() == 0


def test_tree_follows_the_longest_suffix():
    texts = ["abab abc", "abab abd", "xaby abab"]
    x, at = suffix_tree.symbols(pa.array(texts * 20))
    assert bytes(x[at[0] : at[1]]) == b"abab abc \n"
    found = suffix_tree.frequent(x, 2, 4)
    codes = np.concatenate([c | np.uint64(i + 1) << np.uint64(56) for i, c in enumerate(found)])
    tree = suffix_tree.Automaton(codes, np.union1d(x, [10, 32]))
    contexts = {c.to_bytes(8, "big")[8 - int(n):]: s for s, (c, n) in enumerate(zip((tree.codes & np.uint64((1 << 56) - 1)).tolist(), tree.lengths, strict=True))}
    places = tree.read(x, 4, None)
    for i in range(1, len(x)):
        begin = max(int(at[np.searchsorted(at, i, side="right") - 1]) - 1, i - 4)  # an end comes before every text
        seen = b"\n" + bytes(x)
        longest = next(seen[j + 1 : i + 1] for j in range(begin, i + 1) if seen[j + 1 : i + 1] in contexts)
        assert places[i] // tree.width == contexts[longest]
    counts = np.bincount(places, minlength=len(tree.table))
    model = suffix_tree.grow(tree, counts, 4, 2)
    chance = 10.0 ** model.values.reshape(-1, tree.width)
    assert np.allclose(chance[:, :-1].sum(axis=1) + chance[:, -1] * (256 - tree.width + 1), 1, atol=1e-4)


def test_tree_keeps_rare_contexts_that_diverge(spark, monkeypatch):
    """Of a corpus where contexts seen twice make up far less than 1e-5 of the symbols, the tree is the one made in memory."""
    monkeypatch.setattr(suffix_tree, "GROUP_BYTES", 200_000)
    texts = {i: prose(60 + i, 20_000) + " quartz vexing" * 2 for i in range(5)} | {5: None, 6: "a quartz vexing", 7: "\x00 é\x00"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in suffix_tree.scores(docs, remainder("doc_id", 1000) == zlib.crc32(b"6") % 1000).collect()}
    assert [i for i in texts if rows[i].held_out] == [6]
    train = [i for i in texts if i != 6]
    x, _ = suffix_tree.symbols(pa.array([texts[i] for i in train], pa.string()))
    assert len(x) > 5e5
    found = suffix_tree.frequent(np.concatenate([[10], x]).astype(np.uint8), 2, 7)
    codes = np.concatenate([c | np.uint64(i + 1) << np.uint64(56) for i, c in enumerate(found)])
    automaton = suffix_tree.Automaton(codes, np.union1d(x, [10, 32]))
    tree = suffix_tree.grow(automaton, np.bincount(automaton.read(x, 7, None), minlength=len(automaton.table)), 7, 2)
    counts = Counter(w for i in train for w in (texts[i] or "").encode().lower().split())
    total = sum(counts.values()) + len(train)
    said = {i: tree.tokens(suffix_tree.symbols(pa.array([t], pa.string()))[0]) for i, t in texts.items()}
    held = {i: np.array([counts[w] for w in (t or "").encode().lower().split()] + [len(train)]) for i, t in texts.items()}
    left = sum(suffix_tree.smoothed(held[i] - 1, said[i], total - 1).sum(axis=1) for i in train)
    for i in texts:
        want = suffix_tree.smoothed(held[i], said[i], total).sum(axis=1)[int(np.argmax(left))]
        assert rows[i].score == pytest.approx(want, rel=1e-4)


def test_vectors(spark):
    random = np.random.default_rng(0)
    base = random.standard_normal((40, 16))
    near = base[:20] + 0.12 * random.standard_normal((20, 16))
    rows = [[float(v) for v in x] for x in [*base, *near, base[0], base[0] * 3]]
    rows += [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0]]
    frame = spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<double>, unit string")
    found = {r.vec_id: r for r in binary_codes.vector_links(frame).collect()}
    x = np.array(rows[:62])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    smallest = np.arange(62)
    for _ in range(62):
        smallest = np.array([min([smallest[i], *smallest[linked[i]]]) for i in range(62)])
    for i in range(62):
        assert (found[i].n_links, found[i].component_id) == (linked[i].sum(), smallest[i])
    for i in range(62, len(rows)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert binary_codes.vector_links(frame.limit(0)).count() == 0


def test_pages(spark):
    def page(i):
        return (
            f"<html><head><title>t{i}</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav>"
            f"<div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; {i}</h1><p>One {i}\n two<p>Three<br>four</article>"
            f"<section id=comments><p>nice {i}</p></section><form><p>mail</form><footer>&copy; site</footer></body></html>"
        )

    rows = [(i, f"http://a.example/{i}", page(i), "x") for i in range(6)]
    rows += [(6, None, None, "x"), (7, "http://b.example", "", "x"), (8, "nonsense", "plain &lt;text&gt;", None), (None, "http://a.example", page(9), None), rows[0]]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, row string")
    found = page_template.extract(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        i = r.row.page_id
        want = {6: "", 7: "", 8: "plain <text>"}.get(i, f"Head & {9 if i is None else i}\n\nOne {9 if i is None else i} two\n\nThree four")
        assert r.main_text == want
    tokens = page_template.classes(frame.selectExpr("page_id as key", "url", "html").where("key < 6")).where("host = 'a.example'").collect()
    by_class = defaultdict(set)
    for t in tokens:
        by_class[t["class"]].add(t.token.removeprefix(">html>body>"))
    once = next(c for c in by_class.values() if "article" in c)
    assert {"article>h1", "nav", "footer"} <= once and "article>p" not in once
    assert page_template.extract(frame.limit(0)).count() == 0


def test_a_slot_holds_all_text_down_to_the_next_class(spark):
    """Links in tokens that single pages have are part of the template's slot around them, which is a menu then."""
    page = "<html><body><div class='box'><div class='{0}'><a href='/'>Home sweet home</a></div></div><div class='words'><p>text {0}</p></div></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(w)) for i, w in enumerate(["one", "two", "three", "four"])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    template = page_template.templates(frame.selectExpr("page_id as key", "url", "html")).first().tokens
    box = next(t for t in template if t.token == ">html>body>div.box")
    assert box.chars == box.linked == 4 * len("Homesweethome") and not any("div.one" in t.token for t in template)
    found = {r.row.page_id: r.main_text for r in page_template.extract(frame).collect()}
    assert found == {i: f"text {w}" for i, w in enumerate(["one", "two", "three", "four"])}
    slots = page_template.Slots([t.asDict() for t in template] + [{"token": ">html>body>article", "class": template[0]["class"], "chars": 0, "linked": 0}])
    whole = {t.token for t in template} | {">html>body>article"}
    assert slots.roots_on(whole) == (">html>body>article",) and slots.roots_on({">html", ">html>body>article"}) == ()


def test_pages_of_another_layout_keep_their_text(spark):
    def page(i, before="<body>", begin="<article class='post'>", end="</article>", more=""):
        return f"<html>{before}<nav><a href='/'>Home</a></nav>{begin}<p>text {i}</p>{end}{more}<footer>site</footer></body></html>"

    pages = [page(i) for i in range(6)]
    pages += [
        page(6, begin="<div class='story'>", end="</div>"), page(7, begin="<section>", end="</section>"),
        page(8, begin="<article class='post featured'>"), page(9, before="<body class='wide'>"),
        page(10, before="<body><div>"), page(11, more="<article class='post featured'><p>more</p></article>"),
    ]
    rows = [(i, f"http://a.example/{i}", h) for i, h in enumerate(pages)]
    found = page_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.row.page_id: r.main_text for r in found} == {i: f"text {i}" + "\n\nmore" * (i == 11) for i in range(12)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7)]
    links = spark.createDataFrame(chain, "a long, b long")
    found = {r.id: r.component_id for r in common.components(links, "a", "b").collect()}
    assert found == {**dict.fromkeys(range(61), 0), **{100 + i: 100 for i in range(40)}}


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage decides on its own input as the operators' brute-force versions do."""
    spark.createDataFrame([(1, " ".join(prose(2).split()[20:60]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select(corpus_pipeline.COLUMNS)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    texts, now = dict(enumerate(TEXTS)), rows
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, str(tmp_path))
        if at == 0:
            texts = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
        elif at == 1:
            texts = {i: v[2] for i, v in lines_by_hand(texts).items()}
        elif at == 2:
            found = classes_by_hand(texts)
            texts = {i: t for i, t in texts.items() if found[i] == i}
        elif at == 3:
            texts = {i: t for i, t in texts.items() if i != 13}
        if at < 4:
            assert after.columns == corpus_pipeline.COLUMNS
            assert {r.doc_id: r.text for r in after.collect()} == texts
            now = spark.createDataFrame(after.collect(), after.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(texts)


def test_index_grows_by_batches(spark, monkeypatch):
    """An index that begins with one line takes a hundred, then thousands, and gives documents back again."""
    monkeypatch.setattr(line_index, "KEYS_PER_SHARD", 300)

    def batch(first: int, lines: int, holders: int = 6):
        return [(first + d, "\n".join(f"common line number {i:07d} of the batch {first}, {'x' * 20}" for i in range(lines))) for d in range(holders)]

    def dropped(rows):
        """Rows to drop by exact counts: all lines but in the largest holder, where five or more documents hold them."""
        held = defaultdict(set)
        for d, text in rows:
            for line in text.split("\n"):
                held[line].add(d)
        return {d: sum(len(held[x]) >= 5 and d != max(held[x]) for x in text.split("\n")) for d, text in rows}

    index = line_index.LineIndex(spark, line_index.shared_folder(spark, "grows"))
    rows, shards = [], []
    for step in ([(0, "short")], batch(10, 1), batch(20, 100), batch(30, 4000), batch(40, 10, 4)):
        index.insert(spark.createDataFrame(step, "doc_id long, text string"))
        rows += step
        shards.append(index.shards)
        table = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["row"].doc_id: r.n_dropped for r in index.drop_repeated(table).collect()} == dropped(rows)
    assert shards[-1] > 2 * shards[0]
    index.delete(spark.createDataFrame([(30,), (31,), (20,)], "doc_id long"))
    rows = [r for r in rows if r[0] not in (30, 31, 20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["row"].doc_id: r.n_dropped for r in index.drop_repeated(table).collect()} == dropped(rows)
    index.insert(spark.createDataFrame([(50, rows[-1][1]), (51, dict(rows)[32])], "doc_id long, text string"))
    rows += [(50, rows[-1][1]), (51, dict(rows)[32])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["row"].doc_id: r.n_dropped for r in index.drop_repeated(table).collect()} == dropped(rows)
