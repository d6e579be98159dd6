"""Merkle manifest, prefix trie and token counts against plain versions and the library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from supportlake.llm import bpe, merkle, prefix_trie, token_counts
from supportlake.llm.queries import merkle_digest, rebuilt_conversations, word_tokenizer
from tests.llm.test_operators import make_docs, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest --------------------------------------------------------------------


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Levels of digests from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + 2])) for i in range(0, len(low), 2)])
    return levels


def plain_climb(levels, at, h):
    proof = ""
    for level in levels[:-1]:
        run = level[at // 2 * 2 : at // 2 * 2 + 2]
        left, right = run[: at % 2], run[at % 2 + 1 :]
        proof += "".join(left + right)
        h = sha("".join(left + [h] + right))
        at //= 2
    return proof, h


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = plain_leaf(i, source, lang, n, text)
        shown = leaf
        if i is not None and zlib.crc32(str(i).encode()) % 7 == 0:
            shown = plain_leaf(i, source, lang, None if n is None else n + 1, text)
        groups[lang].append(((i is not None, i or 0, leaf), i, leaf, shown))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: x[0])
        trees[lang] = plain_tree([leaf for _, _, leaf, _ in groups[lang]])
    top = plain_tree([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for at, (_, i, leaf, shown) in enumerate(groups[lang]):
            proof, h = plain_climb(trees[lang], at, shown)
            more, h = plain_climb(top, g, h)
            root = top[-1][0]
            out.append((i, leaf, trees[lang][-1][0], root, sha(proof + more), h, h == root))
    return sorted(out, key=str)


DOC = "doc_id long, text string, lang string, source string, n_chars long, g int, pos int, n int, hash int, row int, grp int, key int, place int, carried int, member int, path int"
DIGEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def documents(spark, rows):
    return spark.createDataFrame([(*r, *[1] * 11) for r in rows], DOC).repartition(5)


def digest_rows(frame):
    return sorted((tuple(r[c] for c in DIGEST) for r in frame.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_matches_plain_trees(spark, levels, monkeypatch):
    rng = random.Random(levels)
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "en", "en", "de", "é", "z", None])
        text = rng.choice([None, "", "x" * 2000, words(rng, 20), "naïve\n"])
        rows.append((i, text, lang, rng.choice(["a", "", None]), rng.choice([None, 3, 40])))
    rows += [(None, "no id", "en", "a", 1)] * 2 + [(7, "other text", "en", "b", 2)]
    rows += [(200, "again", "en", "a", 5)] * 20 + [(300, "alone", "lone", "a", 1)]
    monkeypatch.setattr(merkle.manifest, "__defaults__", (levels,))
    got = digest_rows(merkle_digest(documents(spark, rows)))
    assert got == plain_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(5, "t", None, "s", 1)]
    got = digest_rows(merkle_digest(documents(spark, rows)))
    assert got == plain_manifest(rows) and got[0][1] == got[0][2] == got[0][3]
    assert got[0][4] == sha("")
    assert merkle_digest(documents(spark, [])).collect() == []


def test_manifest_groups_and_paths(spark):
    rows = [(i, str(i), lang, "s", i) for i, lang in enumerate("aabbbbbbc")]
    docs = documents(spark, rows).withColumn("leaf", merkle.leaf_hash("doc_id", "text"))
    built = merkle.manifest(docs, "leaf", "lang", "doc_id", carried=["doc_id"], levels=1)
    groups = {r["group"]: r for r in built.groups.collect()}
    assert {k: v["n"] for k, v in groups.items()} == {"a": 2, "b": 6, "c": 1}
    leaves = built.leaves.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(leaves) == 9 and {r["folded"] for r in leaves} == {groups["a"]["root"]}
    folded = built.groups.select(merkle.fold(F.col("subroot"), F.col("path")).alias("r")).distinct()
    assert [r["r"] for r in folded.collect()] == [groups["a"]["root"]]
    # Two rows of "b" that change places by their key change its root and the dataset's, only.
    swapped = documents(spark, [(i ^ 1 if lang == "b" else i, t, lang, s, n) for i, t, lang, s, n in rows])
    again = merkle.manifest(
        swapped.withColumn("leaf", merkle.leaf_hash("doc_id", "text")), "leaf", "lang", "doc_id",
        carried=["doc_id"], levels=1,
    )
    other = {r["group"]: r for r in again.groups.collect()}
    assert [g for g in "abc" if other[g]["subroot"] != groups[g]["subroot"]] == ["b"]
    assert other["a"]["root"] != groups["a"]["root"]


# --- prefix trie ------------------------------------------------------------------------


def plain_trie(lists):
    """lists: {conv_id: [(role, text), ...]}; rows as of op12."""
    nodes = defaultdict(list)
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        own = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += not kids[path]
    return sorted(
        (
            min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
            sha(",".join(str(c) for c in sorted(m) if len(lists[c]) == len(p))),
        )
        for p, m in nodes.items()
    )


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def node_rows(frame):
    return sorted(
        (tuple(r[c] for c in NODE) for r in frame.collect()), key=lambda r: (*r[:2], str(r))
    )


def conversation_rows(lists):
    return [(c, i, role, text) for c, turns in lists.items() for i, (role, text) in enumerate(turns)]


def sequences(spark, lists, parts=6):
    rows = spark.createDataFrame(
        conversation_rows(lists), "conv_id long, turn long, role string, text string"
    )
    turns = prefix_trie.turn_lists(rows)
    empty = spark.createDataFrame([(c,) for c, t in lists.items() if not t], "conv_id long")
    none = F.lit(None).cast("array<string>")
    return turns.unionAll(empty.select("conv_id", none)).repartition(parts)


@pytest.mark.parametrize("run_rows, run_bytes", [(1, 10**9), (3, 10**9), (10**9, 60), (10**9, 10**9)])
def test_trie_matches_plain_tree(spark, run_rows, run_bytes):
    rng = random.Random(run_rows % 97 + run_bytes % 89)
    turns = [(rng.choice(["user", "assistant", ""]), words(rng, rng.randrange(4))) for _ in range(4)]
    lists = {c: [rng.choice(turns) for _ in range(rng.choice([0, 1, 2, 3, 6]))] for c in range(120)}
    lists |= {200 + c: lists[4] or [turns[0]] for c in range(40)}  # copies, more than a run
    lists |= {300 + c: [turns[1]] * c for c in range(30)}  # each goes on where another ends
    got = node_rows(prefix_trie.prefix_trie(sequences(spark, lists), run_rows, run_bytes))
    expected = sorted(plain_trie(lists), key=lambda r: (*r[:2], str(r)))
    assert got == expected


def test_trie_links_nodes_by_their_paths(spark):
    lists = {1: [("u", "a b"), ("v", "c")], 2: [("u", "a b")], 3: [("v", "c")]}
    nodes = {r["node"]: r for r in prefix_trie.prefix_trie(sequences(spark, lists), 1).collect()}
    assert len(nodes) == 4
    for row in nodes.values():
        if row["depth"]:
            assert nodes[row["parent"]]["depth"] == row["depth"] - 1
            assert nodes[row["parent"]]["conv_id"] == row["parent_conv_id"]
    assert len({bytes(r["turn"]) for r in nodes.values()}) == 3  # of root, "a b", "c"


def test_trie_of_nothing_and_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, key string, run int, node int, turns int"
    assert prefix_trie.prefix_trie(
        prefix_trie.turn_lists(spark.createDataFrame([], schema))
    ).collect() == []
    rows = [
        (1, 2, "u", "later"), (1, None, None, None), (1, 2, "u", "later"), (1, 0, "u", None),
        (None, 0, "u", "nobody's"), (2, 0, None, ""), (3, 0, "", "word " * 50_000),
    ]
    frame = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], schema)
    got = node_rows(prefix_trie.prefix_trie(prefix_trie.turn_lists(frame)))
    lists = {
        1: [("", ""), ("u", ""), ("u", "later"), ("u", "later")], 2: [("", "")],
        3: [("", "word " * 50_000)],
    }
    assert got == sorted(plain_trie(lists), key=lambda r: (*r[:2], str(r)))


def test_rebuilt_conversations_share_starts(spark):
    rng = random.Random(8)
    lists = {c: [("u", words(rng, 2)) for _ in range(rng.randint(1, 5))] for c in range(130) if c != 40}
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame(conversation_rows(lists), schema)
    expected = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 4
        expected[c] = lists.get(c - c % 20, [])[:h] + own[h:]
    got = node_rows(prefix_trie.prefix_trie(rebuilt_conversations(rows)))
    assert got == sorted(plain_trie(expected), key=lambda r: (*r[:2], str(r)))
    assert any(not t for t in expected.values())


def test_radix_tree_layouts_hold_all_keys():
    rng = random.Random(5)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(4))) for _ in range(4000)}
    keys |= {b"\x01" * n for n in range(200)} | {bytes([b]) for b in range(256)}
    keys |= {b"\x07" * 30 + bytes([b]) + b"tail" for b in range(0, 256, 6)}
    tree = prefix_trie.RadixTree()
    shuffled = list(keys)
    rng.shuffle(shuffled)
    for key in shuffled:
        tree.put(key, key)
    kinds, found, todo = set(), [], [(tree.root, b"")]
    while todo:
        node, above = todo.pop()
        path = above + node.shared
        if node.value is not None:
            assert node.value == path
            found.append(path)
        kids = list(node.below)
        kinds.add((type(node.below).__name__, getattr(node.below, "room", 0)))
        assert [b for b, _ in kids] == sorted(b for b, _ in kids)
        assert node.value is not None or len(kids) > 1 or node is tree.root
        assert all(node.below.get(b) is kid for b, kid in kids)
        todo += [(kid, path + bytes([b])) for b, kid in reversed(kids)]
    assert found == sorted(keys)
    assert kinds == {("Sorted", 4), ("Sorted", 16), ("Indexed", 0), ("Direct", 0)}


# --- token counts -----------------------------------------------------------------------

ODD_TEXTS = [
    None, "", " \n\t", "a", "Don't, DON'T 's x's I'll'd <|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>",
    "<|startoftext|><|endoftext|>", "a\x1cb\x85c　d​e", "ﬁ İstanbul ß. ǅ 12,5 ½.",
    "é ́a " * 5, "ΑΣ, Σ. ΟΔΟΣ", "日本語のテキスト、中文。", "aaaa aaaaaaaaa " + "ab" * 500 + " " + "a" * 3001,
    "𝔘𝔫𝔦 🙂🙂 naïve'll don’t", "\x00\x01 ﻿‍x", "ȩ́ q̣̇", "...!!! --- '' '", "x" * 200_000,
]


def library_counts(path, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library(spark, tiny):
    rng = random.Random(4)
    texts = ODD_TEXTS + [
        "".join(rng.choice("abAB '’.,0é中 \n̈") for _ in range(rng.randrange(60))) for _ in range(400)
    ]
    texts += [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    texts += texts[:3]
    path = word_tokenizer()
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]
    docs = make_docs(spark, texts, ids).withColumn("n_tokens", F.lit("x")).repartition(3)
    got = sorted(map(str, token_counts.count_tokens(docs, path, limit=50).collect()))
    expected = [
        (i, len((t or "").encode()), n, n > 50)
        for i, t, n in zip(ids, texts, library_counts(path, texts))
    ]
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    assert got == sorted(map(str, spark.createDataFrame(expected, schema).collect()))
    assert token_counts.count_tokens(docs.limit(0), path).collect() == []


def test_token_counts_under_another_byte_level_file():
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    texts = [t or "" for t in ODD_TEXTS[:-1]] + [words(rng, 50, "theonrsa ") for _ in range(50)]
    counts = bpe.BatchTokenizer(path).count([t.encode() for t in texts])
    assert counts.tolist() == library_counts(path, texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_equal_the_library(name, monkeypatch):
    """Also where texts are cut into small portions, between words."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(name))
    rng = random.Random(3)
    texts = [t or "" for t in ODD_TEXTS] + ["ÀÉÞß÷×ÿ Ã¥Ü9é8'É É's", "é̈ ñ́ c'est l'été n'a"]
    texts += [
        "".join(rng.choice("abAB '’.,0éÉ×ßÿ中 \n̈\x1f<|") for _ in range(rng.randrange(60)))
        for _ in range(600)
    ]
    texts.append(words(rng, 4000, "abcdeé") + "x" * 300)
    library = Tokenizer.from_file(path)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    for portion in (bpe.PORTION, 40):
        monkeypatch.setattr(bpe, "PORTION", portion)
        ids, size = bpe.BatchTokenizer(path).encode(raw)
        assert size.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]


def test_merges_are_those_of_a_queue_by_rank():
    """Against the plain rule: merge the lowest rank, leftmost first, until none is left."""
    rng = random.Random(6)
    letters = bpe.byte_letters()
    for _ in range(30):
        vocab = {x: i for i, x in enumerate(letters)}
        merges, tokens = [], ["a", "b", "c"]
        for _ in range(25):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair not in merges and pair[0] + pair[1] not in vocab:
                merges.append(pair)
                vocab[pair[0] + pair[1]] = len(vocab)
                tokens.append(pair[0] + pair[1])
        merger = bpe.PairMerger({"type": "BPE", "vocab": vocab, "merges": merges})
        rank = {p: i for i, p in enumerate(merges)}
        cases = ["".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]
        expected = []
        for case in cases:
            row = list(case)
            while True:
                at = [(rank[p], i) for i, p in enumerate(zip(row, row[1:])) if p in rank]
                if not at:
                    break
                _, i = min(at)
                row[i : i + 2] = [row[i] + row[i + 1]]
            expected.append(len(row))
        assert merger.count([c.encode() for c in cases]).tolist() == expected


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.PairMerger({"type": "Unigram", "vocab": {}, "merges": []})
    with pytest.raises(ValueError):
        bpe.PairMerger({"type": "BPE", "byte_fallback": True, "vocab": {}, "merges": []})
