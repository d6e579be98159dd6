"""The ten operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from supportlake.llm import (
    chat_format,
    components,
    decontaminate,
    embedding_dedup,
    language_id,
    line_dedup,
    packing,
    quality,
    simhash,
    substring_dedup,
    url_filter,
)
from supportlake.llm.queries import contamination_digest, word_tokenizer

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, hash string, key int, "
    "pos int, n int, fp int, chunk int, vector string, _row int"
)


def make_docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [
        (i, t, "en", "src", len(t or ""), "h", 1, 2, 3, 4, 5, "v", 6) for i, t in zip(ids, texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, letters="ab"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 2))) for _ in range(n))


def union_find(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    pairs += [(200 + i, 201 + i) for i in range(40)] + [(500, i) for i in range(100, 140)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    expected = union_find(501, pairs)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r["node"]: r["component"] for r in got} == {
        x: expected[x] for x in linked if expected[x] != x
    }
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- packing ----------------------------------------------------------------------------

ODD_TEXTS = [
    None, "", "a", "Don't, DON'T 's x's <|endoftext|> a<|endoftext|>b", "a\x1cb\x85c　d​e",
    "ﬁ İstanbul ß. ǅ 12,5 ½.", "é ́a " * 5, "ΑΣ, Σ.",
]


def check_packed(pieces, docs, window):
    """pieces: rows of pack(); docs: (doc_id, ids) as they should be."""
    rows = [r.asDict() for r in pieces.collect()]
    assert Counter(i for i, _ in docs) == Counter(r["doc_id"] for r in rows if r["start"] == 0)
    whole = defaultdict(list)
    for i, ids in docs:
        whole[i].append(ids)
    cut = defaultdict(list)
    for r in rows:
        cut[r["doc_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for i, held in cut.items():
        assert sum(r["length"] for r in held) == sum(map(len, whole[i]))
        if len(whole[i]) == 1:
            held.sort(key=lambda r: r["start"])
            assert [r["start"] for r in held] == list(
                np.cumsum([0] + [r["length"] for r in held[:-1]])
            )
            joined = np.frombuffer(b"".join(r["ids"] for r in held), "<u4")
            assert joined.tolist() == whole[i][0]
            assert all(r["doc_tokens"] == len(whole[i][0]) for r in held)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
        sizes.append(at)
    # The last sequence of the greedy part may be short.
    return (sum(sizes) + window - min(sizes)) / (window * len(sizes)) if sizes else 1.0


def expected_ids(texts):
    tokenizer = Tokenizer.from_file(word_tokenizer())
    return [
        tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts
    ]


@pytest.mark.parametrize("window,grain", [(64, 4), (4096, 16)])
def test_packing_round_trip(spark, window, grain):
    rng = random.Random(5)
    texts = ODD_TEXTS + [words(rng, rng.randint(0, 60), "abcé,.") for _ in range(300)]
    texts.append(words(rng, 9000))
    ids = [*range(len(texts) - 2), 7, 7]  # two more rows of one id
    docs = make_docs(spark, texts, ids)
    pieces = packing.pack(docs, word_tokenizer(), window=window, grain=grain)
    filled = check_packed(pieces, list(zip(ids, expected_ids(texts))), window)
    assert filled > 0.9
    digest = {
        (r["doc_id"], r["sequence_id"], r["offset"]): r["ids_crc32"]
        for r in packing.digest(pieces).collect()
    }
    for r in pieces.collect():
        assert digest[r["doc_id"], r["sequence_id"], r["offset"]] == zlib.crc32(r["ids"])


def test_packing_of_one_length_and_of_nothing(spark):
    docs = make_docs(spark, ["a b c d e f g h i j"] * 200)
    filled = check_packed(
        packing.pack(docs, word_tokenizer(), window=16, grain=4),
        list(zip(range(200), expected_ids(["a b c d e f g h i j"] * 200))), 16,
    )
    assert filled > 0.99
    assert packing.pack(docs.limit(0), word_tokenizer()).count() == 0


def test_nnls_is_the_constrained_minimum():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.random(8)
        _, x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert x.min() >= 0 and slope.max() < 1e-6 and abs(slope[x > 0]).max(initial=0) < 1e-6


def test_plan_places_nearly_all_tails():
    """Also short ones, of which many fill a window; every tail at most once, windows exactly."""
    rng = np.random.default_rng(1)
    for tails in (
        rng.integers(1, 257, 4000), np.minimum(256, rng.exponential(25, 6000).astype(int) + 1),
        np.full(999, 100), rng.integers(120, 140, 500), np.array([256]), np.array([], int),
    ):
        histogram = np.bincount(tails, minlength=257)
        made = packing.plan(histogram)
        ranks = {b: [] for b in range(1, 257)}
        filled = np.zeros(made.sequences, int)
        for b, low, high, each, seq, slot in made.rows:
            ranks[b].append((low, high))
            assert (high - low) % each == 0
            filled[seq : seq + (high - low) // each] += b * each
        assert (filled == 256).all()
        for b, held in ranks.items():
            held.sort()
            assert [low for low, _ in held] == [0, *(high for _, high in held)][: len(held)]
            assert (held[-1][1] if held else 0) <= histogram[b]
        placed = sum(high - low for _, low, high, *_ in made.rows)
        if tails.size > 1000:
            assert placed > 0.9 * tails.size


# --- chat formatting --------------------------------------------------------------------


def test_chat_round_trip_and_spans(spark):
    rng = random.Random(8)
    bits = ["<|im_end|>", "<\\|", "<\\\\|x", "<", "|>", "\\", "\n", "ok \U0001f600", "<|im_start|>"]
    rows, told = [], {}
    for conv in range(40):
        turns = []
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "sys\\n\n<|", None])
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(8))])
            rows.append((conv, turn, role, text, turn))
            turns.append((role or "", text or ""))
        told[conv] = turns
    rows += [(77, None, "assistant", "b", 0), (77, 1, "assistant", "a", 0), (77, 1, "assistant", "a", 0)]
    told[77] = [("assistant", "b"), ("assistant", "a"), ("assistant", "a")]
    rows += [(None, 0, "assistant", "x", 0)]
    told[None] = [("assistant", "x")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")
    for window in (64, 2):
        got = chat_format.format_conversations(frame, window=window).collect()
        assert len(got) == len(told)
        for r in got:
            turns = told[r["conv_id"]]
            assert chat_format.read_back(r["formatted"]) == turns
            assert "".join(r["formatted"][a:b] for a, b in r["spans"]) == r["formatted"]
            learned = [chat_format.unescape(r["formatted"][a:b]) for a, b in r["loss"]]
            assert learned == [t for role, t in turns if role == "assistant"]
            assert r["rewrites"] == -1
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


def test_chat_detects_rewritten_history():
    def forgetful(messages):
        """Drops what was thought in earlier turns."""
        last = len(messages) - 1
        return "".join(f"[{t if i == last else t.split('/')[-1]}]" for i, (_, t) in enumerate(messages))

    done = chat_format.render_turns([("user", "q"), ("assistant", "think/a"), ("user", "r")], forgetful)
    assert done.rewrites == 2 and done.text == "[q][a][r]"
    many = [("user", f"m{i}") for i in range(300)]
    plain = chat_format.render_turns(many, chat_format.marked_template)
    assert plain == chat_format.render_turns(many, chat_format.marked_template, 1000)

    def numbered(messages):
        return "".join(f"{i}:{t};" for i, (_, t) in enumerate(messages))

    assert chat_format.render_turns(many, numbered) == chat_format.render_turns(many, numbered, 1000)


def forgets_thoughts(messages):
    """Cuts what was thought from earlier assistant turns."""
    last = len(messages) - 1
    return "".join(
        f"[{r}]\n{t if i == last or r != 'assistant' else t.split('think|')[-1]}\n"
        for i, (r, t) in enumerate(messages)
    )


def shows_last_turns(messages):
    return "".join(f"<{r}:{t}>" for r, t in messages[-3:])


def counts_turns(messages):
    return f"{len(messages)} turns" + "".join(f"<{r}:{t}>" for r, t in messages)


def inserts_note(messages):
    return "".join(f"<{r}:{t}>" + "(noted)" * (i < len(messages) - 1) for i, (r, t) in enumerate(messages))


@pytest.mark.parametrize("template", [forgets_thoughts, shows_last_turns, counts_turns, inserts_note])
def test_spans_of_rewritten_history_lie_in_the_final_text(spark, template):
    rng = random.Random(3)
    told, rows = {}, []
    for conv in range(12):
        turns = [
            (("user", "assistant")[k % 2], f"{'think|' * (k % 2)}t{conv}x{k}y{rng.randrange(99)}")
            for k in range(rng.randint(1, 7))
        ]
        told[conv] = turns
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.format_conversations(frame, template).collect():
        turns, text = told[r["conv_id"]], template(told[r["conv_id"]])
        assert r["formatted"] == text
        kept = {forgets_thoughts: 2, shows_last_turns: 3, counts_turns: 0, inserts_note: 99}
        assert (r["rewrites"] >= 0) == (len(turns) > kept[template])
        # Texts are unique, so a plain search says what is shown of each, and where.
        shown, spans = [], r["spans"]
        for (role, t), (begin, end) in zip(turns, spans):
            whole = text.find(t)
            part = t if whole >= 0 else t.split("think|")[-1]
            at = text.find(part)
            if at < 0:
                assert begin == end  # not shown
                continue
            assert 0 <= begin <= at and at + len(part) <= end <= len(text)
            assert sum(other[1].split("think|")[-1] in text[begin:end] for other in turns) == 1
            if role == "assistant":
                shown.append(part)
        assert [text[a:b] for a, b in r["loss"]] == shown


# --- decontamination --------------------------------------------------------------------


def brute_phrases(text, items, size=10):
    doc, hit, found = decontaminate.words_of((text or "").encode()), set(), set()
    for name, item in items:
        ws = decontaminate.words_of((item or "").encode())
        for a in range(max(1, len(ws) - size + 1) if ws else 0):
            win = ws[a : a + size]
            for b in range(len(doc) - len(win) + 1):
                if doc[b : b + len(win)] == win:
                    hit.update(range(b, b + len(win)))
                    found.add(name)
    return len(doc), hit, found


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_decontamination_matches_brute_force(spark, block_bytes):
    rng = random.Random(2)
    items = [(str(k), words(rng, rng.randint(0, 14))) for k in range(12)]
    items += [("x", None), ("y", "?!"), ("3", items[3][1])]
    texts = [None, "", "A-b!é"] + [words(rng, rng.randint(0, 80), "abAB") for _ in range(60)]
    texts += [words(rng, 3000), texts[5]]
    texts += ["so " + items[k][1] + ", end" for k in range(12)]
    docs = make_docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.find_phrases(docs, bench, shard_words=500, block_bytes=block_bytes)
    assert found.columns[: len(docs.columns)] == docs.columns
    rows = {r["doc_id"]: r for r in found.collect()}
    cut = {r["doc_id"]: r for r in decontaminate.remove_spans(found).collect()}
    for i, text in enumerate(texts):
        n, hit, names = brute_phrases(text, items)
        got = {x for a, b in rows[i]["_spans"] for x in range(a, b)}
        assert (rows[i]["_n_words"], got, set(rows[i]["_items"])) == (n, hit, names)
        ws = decontaminate.words_of((text or "").encode())
        left = decontaminate.words_of((cut[i]["text"] or "").encode())
        if len(hit) < n:
            assert b"".join(w for k, w in enumerate(ws) if k not in hit) == b"".join(left)
        assert cut[i]["_changed"] == bool(hit)
    digest = contamination_digest(found).filter("contaminated").count()
    assert digest == sum(bool(brute_phrases(t, items)[1]) for t in texts)
    assert decontaminate.find_phrases(docs.limit(0), bench).count() == 0
    none = decontaminate.find_phrases(docs, bench.limit(0))
    assert none.filter("size(_spans) > 0").count() == 0 and none.count() == len(texts)


def test_decontamination_takes_any_column_names(spark):
    names = ["_n_words", "_spans", "_items", "_changed"]
    docs = make_docs(spark, ["one two three four", None])
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i))
    bench = spark.createDataFrame([("a", "two three")], "item_id string, text string")
    found = decontaminate.find_phrases(docs, bench)
    cut = decontaminate.remove_spans(found)
    assert [found.columns.count(n) for n in names] == [1, 1, 1, 0]
    assert cut.columns == [c for c in docs.columns if c not in names] + ["_changed"]
    assert [r["text"] for r in cut.filter("_changed").collect()] == ["one  four"]
    assert contamination_digest(found).filter("n_hit = 2").count() == 1


def test_hits_of_a_common_phrase_are_sorted_once():
    """Each document's hits, also where one phrase stands in all documents."""
    rng = random.Random(4)
    common = [f"c{i}".encode() for i in range(14)]
    shard_docs = [[f"w{rng.randrange(50)}".encode() for _ in range(rng.randrange(9))] + common * (i % 3) for i in range(300)]
    blocks = [decontaminate.phrase_block([("x", b" ".join(common)), ("y", b"w1 w2")], 10)]
    hits, found = [None] * 300, [None] * 300
    for shard in decontaminate._shards(shard_docs, 100_000, 20):
        decontaminate._search_shard(shard, blocks, hits, found, 8)
    for i, doc in enumerate(shard_docs):
        _, hit, names = brute_phrases(b" ".join(doc).decode(), [("x", b" ".join(common).decode()), ("y", "w1 w2")])
        spans = [] if hits[i] is None else decontaminate.merge_spans(np.concatenate(hits[i])).tolist()
        assert {x for a, b in spans for x in range(a, b)} == hit
        assert (found[i] or set()) == names


# --- classifiers ------------------------------------------------------------------------


def test_quality_learns_held_out_rows_and_no_held_out_labels(spark):
    rng = random.Random(4)
    clean = [words(rng, rng.randint(5, 60), "abcdef").capitalize() + "." for _ in range(400)]
    junk = [
        " ".join(w.upper() + "!!" for w in words(rng, rng.randint(5, 60), "abcdef").split())
        for _ in range(200)
    ]
    texts = clean + junk + [None, "", clean[0]]
    docs = make_docs(spark, texts)
    truth = [(i, int(i < 400), 0) for i in range(600)] + [(3, None, 0), (None, 1, 0)]
    labels = spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} >= set(held)
    assert np.mean([got[i]["predicted"] == (i < 400) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    flipped = spark.createDataFrame(
        [(i, 1 - q if i in held and q is not None else q, t) for i, q, t in truth], labels.schema
    )
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, flipped).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in got)
    kept = quality.filter_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    only = quality.score_quality(docs.limit(3), labels.filter("quality = 1"))
    assert [r["score"] for r in only.collect()] == [1.0] * 3
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_language_learns_held_out_rows(spark):
    rng = random.Random(6)
    letters = {"aa": "abcd", "bb": "cdef", "cc": "абвг"}
    rows = []
    for i in range(450):
        lang = rng.choice(sorted(letters))
        rows.append((i, words(rng, rng.randint(3, 40), letters[lang]), lang, 0))
    rows += [(450, None, "aa", 0), (451, "12 !?", "bb", 0), (452, "", "cc", 0), (453, "abab", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    held = [r for r in rows[:450] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (450, 451, 452)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    wrong = spark.createDataFrame(
        [(r[0], r[1], "zz" if r in held else r[2], 0) for r in rows], docs.schema
    )
    again = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(wrong).collect()}
    assert again == {i: r["lang_pred"] for i, r in got.items()}
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.filter("lang is null")).collect()} == {"und"}


# --- near-duplicates --------------------------------------------------------------------


def plain_fingerprint(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    lines = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in lines]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("large", [4096, 3])
def test_simhash_matches_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_GROUP", large)
    rng = random.Random(9)
    base = [words(rng, 120, "abcdefgh") for _ in range(12)]
    texts = [None, "", " \t", "One", "one two", *base, base[0]]
    for b in base:
        for _ in range(6):
            ws = b.split()
            for _ in range(rng.randint(1, 3)):
                ws[rng.randrange(len(ws))] = rng.choice("xyz")
            texts.append(" ".join(ws))
    texts.append(words(rng, 40_000))
    fps = [plain_fingerprint(t) for t in texts]
    pairs = [
        (i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3
    ]
    expected = union_find(len(fps), pairs)
    docs = make_docs(spark, texts)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i]["fp"] % 2**64 for i in range(len(fps))] == fps
    assert [got[i]["component_id"] for i in range(len(fps))] == expected
    assert len(set(expected)) < len(fps) - 10
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_gray_index_matches_brute_force(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 120))
        fps = rng.integers(0, 2**63, 5, dtype=np.uint64)[rng.integers(0, 5, n)]
        for _ in range(int(rng.integers(0, 6))):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        both = np.unique(np.stack([rng.integers(0, 3, n).astype(np.uint64), fps], 1), axis=0)
        order = np.lexsort((simhash.gray_rank(both[:, 1]), both[:, 0]))
        group, fps = both[order, 0].astype(np.int64), both[order, 1]
        number = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
        monkeypatch.setattr(simhash, "SEARCH_BLOCK", int(rng.choice([3, 16, 4096])))
        near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
        near &= group[:, None] == group[None]
        assert simhash.GrayIndex(fps, number).search(3).tolist() == union_find(
            fps.size, np.argwhere(near).tolist()
        )


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 24))
    vectors = [c + rng.normal(0, s, 24) for c in centers for s in (0, 0.05, 0.12, 0.14, 0.16, 0.2)]
    vectors += [vectors[0], vectors[0] * 3, vectors[1] * 1e30]
    rows = [(i, v.tolist(), i % 2, 1) for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] * 24]
    rows += [(n + i, v, 0, 1) for i, v in enumerate(odd)]
    rows += [(n + 6, vectors[0].tolist(), None, 1), (n + 7, vectors[0][:23].tolist(), 0, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key int")
    pairs = []
    for i in range(n):
        for j in range(i):
            a, b = vectors[i] / np.abs(vectors[i]).max(), vectors[j] / np.abs(vectors[j]).max()
            if i % 2 == j % 2 and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                pairs.append((i, j))
    links = Counter(x for p in pairs for x in p)
    expected = union_find(len(rows), pairs)
    for tile in (512, 7):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame, tile=tile).collect()}
        assert [got[i]["n_links"] for i in range(len(rows))] == [links[i] for i in range(len(rows))]
        assert [got[i]["component_id"] for i in range(len(rows))] == expected
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert len(pairs) > 30
    twice = embedding_dedup.near_duplicates(frame.filter("vec_id = 0").unionAll(frame.filter("vec_id = 0")))
    assert [tuple(r) for r in twice.collect()] == [(0, 1, 0, True)] * 2
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(frame.filter(f"vec_id >= {n}")).count() == 8


# --- lines, passages, addresses ---------------------------------------------------------


@pytest.mark.parametrize("batches,fanout", [(4, 2), (1, 2), (5, 3)])
def test_line_dedup_matches_brute_force(spark, batches, fanout):
    rng = random.Random(7)
    pool = [f"A line of the pool, number {i}É" for i in range(8)] + ["short", ""]
    texts = [None, "", "\n\n"]
    for _ in range(50):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 7))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) for x in lines]
        texts.append("\n".join([*lines, f"a line that only one has {rng.random()}"]))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[5] = ids[6]  # one id, two texts
    docs = make_docs(spark, texts, ids)

    def key(line):
        return "".join(
            c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r")
        )

    holders = defaultdict(set)
    for i, t in zip(ids, texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    expected = Counter()
    for i, t in zip(ids, texts):
        lines = (t or "").split("\n")
        kept = [
            x for x in lines
            if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i
        ]
        expected[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert expected == Counter(
        (r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()
    )
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def line_rows(spark, ids):
    """One long line that all hold, and lines of two neighbours each."""
    texts = [f"a line that all documents hold\na line that two hold {i // 2:04d}" for i in range(len(ids))]
    schema = f"doc_id {'string' if isinstance(ids[0], str) else 'long'}, text string"
    return spark.createDataFrame(list(zip(ids, texts)), schema).repartition(3)


@pytest.mark.parametrize("kind", [int, "id{:03d}".format])
def test_line_runs_for_any_ids(spark, kind):
    ids = [kind(i) for i in range(60)]
    docs = line_rows(spark, ids)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: int(i != ids[-1]) for i in ids}
    assert len(line_dedup._batch_bounds(docs, 4)) == 3


def test_lines_keep_their_document_by_the_anti_join(spark, monkeypatch):
    """Without a look at earlier runs, a later batch would name its own document."""
    batches = 4

    class Blind(line_dedup.Runs):
        asked = 0

        def tables(self):
            self.asked += 1
            return [] if self.asked <= batches else super().tables()

    ids = list(range(60))
    monkeypatch.setattr(line_dedup, "Runs", Blind)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(line_rows(spark, ids), batches=batches).collect()}
    assert got != {i: int(i != ids[-1]) for i in ids}


@pytest.mark.parametrize("chunk_bytes", [1 << 21, 200])
def test_substring_dedup_matches_brute_force(spark, chunk_bytes):
    rng = random.Random(12)
    window = 7
    shared = [words(rng, rng.randint(5, 30), "abcdefgh") for _ in range(6)]
    texts = [None, "", "one two", "same " * 40]
    for _ in range(60):
        parts = [words(rng, rng.randint(0, 20), "abcdefgh"), rng.choice(shared + [""]),
                 words(rng, rng.randint(0, 9), "abcdefgh")]
        ws = " ".join(parts).split(" ")
        if rng.random() < 0.3 and ws:
            ws[rng.randrange(len(ws))] = "changed"
        texts.append("\n ".join(ws))
    texts += [texts[10], texts[11].upper(), words(rng, 5000, "abcdefghij")]
    lists = [(t or "").split() for t in texts]
    met = Counter(
        tuple(ws[i : i + window]) for ws in lists for i in range(len(ws) - window + 1)
    )
    docs = make_docs(spark, texts)
    got = substring_dedup.remove_repeats(docs, window, 3, chunk_bytes)
    rows = {r["doc_id"]: r for r in got.collect()}
    gone = 0
    for i, ws in enumerate(lists):
        hit = set()
        for a in range(len(ws) - window + 1):
            if met[tuple(ws[a : a + window])] > 1:
                hit.update(range(a, a + window))
        gone += len(hit)
        kept = " ".join(w for k, w in enumerate(ws) if k not in hit)
        assert (rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept"]) == (
            len(ws), len(hit), kept
        ), i
    assert gone > 200
    twice = docs.filter("doc_id = 30").unionAll(docs.filter("doc_id = 30"))
    assert {r["kept"] for r in substring_dedup.remove_repeats(twice, 5, 2).collect()} == {""}
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_redirects_carry_decisions(spark):
    link = '<link rel="canonical" href="{}">'.format
    fresh = "<META content='0; URL={}' HTTP-EQUIV=\"refresh\">".format
    pages = [
        (0, "http://a.example.org/x#t", link("http://bad.net/p")),  # tied to a blocked address
        (1, "http://b.example.org/y", fresh("/z")),
        (2, "http://b.example.org/z", link("http://a.example.org/x?")),
        (3, "http://a.example.org/x?", link("//a.example.org/x")),
        (4, "http://ok.example.net/en/1", link("http://c.example.org/q")),
        (5, "http://c.example.org/q", link("http://bad.net/r")),  # allowed and blocked members
        (6, "http://bad.net/r", None),
        (7, None, link("http://bad.net/p")),
        (8, "no scheme", "<link href=x>"),
        (9, "HTTP://WWW.Example.COM/de/a?b", ""),
        (10, "http://example.net", ""),
        (11, "http://xexample.com/de/", link("")),
        (12, "http://b.example.org/y", ""),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge_pages(frame).collect()}
    verdicts = [got[i]["verdict"] for i in range(13)]
    assert verdicts == [
        "block", "block", "block", "block", "allow", "allow", "block", "allow", "allow", "block",
        "allow", "allow", "block",
    ]
    assert (got[9]["host"], got[9]["path"], got[9]["rule"]) == ("www.example.com", "/de/a", "example.com/de/")
    assert (got[7]["host"], got[7]["path"], got[7]["rule"]) == ("", "", None)
    assert got[10]["rule"] is None and got[6]["rule"] == "net/"
    more = spark.createDataFrame(
        [("http://xexample.com/de/", "http://bad.net/r")], "source string, target string"
    )
    again = {r["page_id"]: r["verdict"] for r in url_filter.judge_pages(frame, redirects=more).collect()}
    assert again[11] == "allow"  # that class has a member that a rule allows
    assert url_filter.judge_pages(frame.limit(0)).count() == 0


def test_language_presence_equals_sets_of_ngrams():
    texts = ["Das ist  ein Haus, 12 Häuser!", "the house is the house", "", "la maison ß", "x"] * 2
    model = language_id.fit(texts[:4], ["de", "en", "xx", "fr"], landmarks=4, features=90)
    asked = texts + ["HAUS haus\n\n the İ 漢字", "9 9", "ein " * 500]
    got = model.presence(asked)

    def grams(text, order):
        low = "".join(
            (c.lower() if len(c.lower()) == 1 else c) if c.isalnum() and not c.isdecimal() else " "
            for c in f" {text} "
        )
        low = f" {' '.join(low.split())} "
        return {low[i : i + order] for i in range(len(low) - order + 1)}

    for order in language_id.ORDERS:
        first, last = np.searchsorted(model.orders, [order, order + 1])
        columns = {}
        for column in range(first, last):
            # A column is known by the texts that hold it.
            where = frozenset(i for i in range(len(asked)) if got[i, column])
            columns[where] = columns.get(where, 0) + 1
        known = sorted({g for t in texts[:4] for g in grams(t, order) if t})
        expected = {}
        for g in known:
            where = frozenset(i for i, t in enumerate(asked) if g in grams(t, order))
            expected[where] = expected.get(where, 0) + 1
        assert last - first <= 30
        if len(known) <= 30:
            assert columns == expected
        else:
            assert all(columns[w] <= expected.get(w, 0) for w in columns)


@pytest.mark.parametrize("steps", [1 << 22, 0])
def test_language_kernel_is_the_full_blended_spectrum(monkeypatch, steps):
    monkeypatch.setattr(language_id, "STEPS", steps)
    rng = random.Random(13)
    letters = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
    texts = [words(rng, 400, letters[i % 2]) for i in range(8)] + ["漢字 仮名交じり文", "ქართული ენა"]
    model = language_id.fit(texts, ["aa", "bb"] * 4 + ["ja", "ka"], landmarks=10)
    asked = [*texts, "abc абв 漢字 ωψ 12", "ქართული", words(rng, 300, letters[0])]

    def grams(text, order):
        low = f" {' '.join(''.join(c.lower() if c.isalpha() else ' ' for c in text).split())} "
        return {low[i : i + order] for i in range(len(low) - order + 1)}

    def alike(a, b):
        return np.mean([
            len(grams(a, n) & grams(b, n)) / (len(grams(a, n)) * len(grams(b, n))) ** 0.5
            for n in (1, 2, 3, 4)
        ])

    expected = [[alike(a, b) for b in texts] for a in asked]
    # Landmarks are the texts of each language in turn.
    order = [0, 1, 8, 9, 2, 3, 4, 5, 6, 7]
    assert np.allclose(model.kernel(asked), np.array(expected)[:, order], atol=1e-5)
    assert model.languages[model.scores(["ქართული"])[0].argmax()] == "ka"


def test_url_verdicts_equal_the_twin_where_links_are(spark, tmp_path):
    """Relative links, refreshes, dot segments, and a hub that a third of all pages point to."""
    from registry import check
    from supportlake.llm.queries import ORACLES, QUERIES

    rng = random.Random(6)
    hosts = ["example.net", "a.example.net", "example.com", "x.org", "bad.net", "other.io"]
    paths = ["/", "/en/", "/en/a/b", "/de/x", "/fr/y", "/p/../de/x", "/q/./r", "/f"]
    rows = []
    for i in range(240):
        url = f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/../a', '#t'])}"
        target = rng.choice(["../../de/x", "./../en/a", "/f", "//x.org/fr/y", "?k=1", "http://Example.com/de/../f", "g/h", "#z", "http://other.io/f"])
        html = rng.choice([
            None, "<p>", f'<link rel="canonical" href="{target}">',
            f"<meta http-equiv='refresh' content='0; url={target}'>", f"<link href={target} rel=canonical>",
        ])
        if i % 3 == 0:
            html = '<link rel="canonical" href="http://hub.io/all">'
        rows.append((i, url, html))
    rows += [(300, None, None), (301, "http://hub.io/all", None), (302, "http://hub.io/./all", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    frame.toPandas().to_parquet(tmp_path / "pages.parquet")
    got = QUERIES["op9_url_filter"](spark, str(tmp_path)).toPandas()
    twin = check.duck(str(tmp_path)).execute(ORACLES["op9_url_filter"]).df()
    assert check.compare(got, twin) == ""
    assert set(got["verdict"]) == {"allow", "block"} and got["rule"].isna().sum() > 20


def test_links_with_dot_segments_carry_decisions(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (0, "http://example.com/de/x", None),
        (1, "http://example.com/en/a/b", link("../../de/x")),
        (2, "http://example.com/en/c", link("./../../../de/./x#t")),
        (3, "http://example.com/en/d", link("http://example.com/en/../de/x")),
        (4, "http://example.com/en/e?../x", link("../de/x?q=/../x")),
        (5, "http://example.com/en/../f", link("/f")),
        (6, "http://example.com/f", link("http://bad.net/a/..")),
        (7, "http://a.example.org/g/..", link("http://bad.net/a/.")),
        (8, "http://a.example.org/", None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_pages(frame).collect()}
    assert [got[i] for i in range(9)] == ["block"] * 9
    paths = {"/a/..": "/", "/a/b/..": "/a/", "/a/.": "/a/", "/../a": "/a", "/a//../b": "/a/b", "/..": "/", "/a.b/..c": "/a.b/..c"}
    rows = spark.createDataFrame([("HTTP://X.net" + k, "http://x.net" + v) for k, v in paths.items()], "url string, good string")
    found = rows.select(url_filter.address_of(rows["url"]).alias("got"), "good").collect()
    assert all(r["got"] == r["good"] for r in found), found


def test_a_chunk_is_told_its_windows_in_arrays():
    """Millions of places are no rows of Python: a chunk's are cut out and spread as arrays."""
    at = np.array([5 << 32 | 7, 2 << 32 | 3, 5 << 32 | 1], np.int64)
    told = {d: w.tolist() for d, w in substring_dedup._windows_told(at, np.array([2, 1, 3]))}
    assert told == {2: [3], 5: [1, 2, 3, 7, 8]}
    assert not list(substring_dedup._windows_told(at[:0], at[:0]))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(k, pa.int64())], ["chunk", "x"])
        for k in ([1, 1, 2], [], [2, 3], [3])
    ]
    assert [t["chunk"].to_pylist() for t in substring_dedup._tables(iter(batches))] == [[1, 1], [2, 2], [3, 3]]
