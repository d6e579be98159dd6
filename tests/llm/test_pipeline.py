"""Stages of the corpus pipeline against brute force, alone and one after the other."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from supportlake.llm import decontaminate, packing, quality
from supportlake.llm.common import table
from tests.llm.test_operators import (
    brute_phrases,
    check_packed,
    expected_ids,
    make_docs,
    plain_fingerprint,
    union_find,
    words,
)

#: Columns with the names that operators use inside.
CLASHES = ["_changed", "_spans", "_items", "_n_words", "n_lines", "n_dropped", "row", "rest", "group_"]


def with_clashes(docs):
    return docs.withColumns({c: F.lit(i + 0.5) for i, c in enumerate(CLASHES)})


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def brute_lines(rows):
    """Rows without lines of 20 or more characters that 3 documents have, but in the last one."""

    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    last = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items()}
    return [
        (
            i,
            "\n".join(
                x for x in (t or "").split("\n")
                if len(holders.get(key(x), ())) < 3 or last[key(x)] == i
            ),
        )
        for i, t in rows
    ]


def check_survivors(rows, kept):
    """Exactly one of each SimHash group stays, one with its least id."""
    fps = [plain_fingerprint(t) for _, t in rows]
    near = [
        (i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3
    ]
    groups = defaultdict(list)
    for (i, t), root in zip(rows, union_find(len(rows), near)):
        groups[root].append((i is None, i or 0, t))
    left = Counter(kept)
    for held in groups.values():
        least = min(x[:2] for x in held)
        fit = [x for x in held if x[:2] == least]
        stayed = [(None if none else i, t) for none, i, t in fit if left[None if none else i, t]]
        assert stayed, held
        left[stayed[0]] -= 1
    assert not +left


def brute_cut(rows, items):
    """Rows without the benchmark's words; those of which nothing is left go."""
    out = []
    for i, t in rows:
        _, hit, _ = brute_phrases(t, items)
        if not hit:
            out.append((i, t))
            continue
        ws = decontaminate.words_of(t.encode())
        out.append((i, [w for k, w in enumerate(ws) if k not in hit]))
    return out


def check_cut(rows, items, kept):
    expected = Counter()
    for i, t in brute_cut(rows, items):
        expected[i, t if isinstance(t, str) or t is None else b" ".join(t)] += 1
    changed = {i for (i, t) in expected if isinstance(t, bytes)}
    got = Counter()
    for i, t in kept:
        got[i, b" ".join(decontaminate.words_of(t.encode())) if i in changed else t] += 1
    missing = expected - got
    assert not got - expected
    assert all(t == b"" for _, t in missing), missing  # of those nothing was left


def test_near_dedup_keeps_rows_not_ids(spark):
    rng = random.Random(1)
    a, b, c, d, e = (words(rng, 150, "abcdefgh") for _ in range(5))
    rows = [
        (None, a), (None, b), (None, b),  # no id: two texts, one of them twice
        (3, c), (3, c), (3, c),  # a row that is repeated
        (4, d), (9, e), (9, d),  # one id, two texts; one is a copy of a smaller id's
        (None, e),  # a copy without an id
    ]
    rng.shuffle(rows)
    docs = with_clashes(make_docs(spark, [t for _, t in rows], [i for i, _ in rows])).repartition(3)
    kept = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(pairs(kept)) == Counter([(None, a), (None, b), (3, c), (4, d), (9, e)])
    assert not corpus_pipeline.one_of_near_copies(spark, docs.limit(0), "").collect()


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "one two", "One  TWO", "one three", words(rng, 3000)]
    for size in (12, 40, 150, 400):
        for _ in range(6):
            base = words(rng, size, "abcdefgh").split()
            for changes in (0, 0, 1, 2, 5):
                ws = list(base)
                for _ in range(changes):
                    ws[rng.randrange(size)] = rng.choice("xyz")
                texts.append(" ".join(ws))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = make_docs(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5)
    kept = pairs(corpus_pipeline.one_of_near_copies(spark, docs, ""))
    check_survivors(rows, kept)
    assert len(rows) - len(kept) > 30


@pytest.mark.parametrize("name", ["good_quality", "without_repeated_lines", "without_benchmark", "packed"])
def test_stages_take_odd_rows(spark, tiny, name):
    stage = getattr(corpus_pipeline, name)
    texts = [None, "", "  ", "a word", "a word", "line\n" * 3, "word " * 30_000]
    docs = with_clashes(make_docs(spark, texts, [None, None, 1, 2, 2, 3, 4]))
    out = stage(spark, docs, tiny).collect()
    assert stage(spark, docs.limit(0), tiny).collect() == []
    if name == "packed":
        ids = [None, None, 1, 2, 2, 3, 4]
        assert check_packed(stage(spark, docs, tiny), list(zip(ids, expected_ids(texts))), 4096) > 0.5
        return
    assert stage(spark, docs, tiny).columns == docs.columns
    assert all([r[c] for c in CLASHES] == [i + 0.5 for i in range(len(CLASHES))] for r in out)
    if name != "good_quality":
        assert len(out) == len(texts)


def test_run_matches_brute_force_stage_by_stage(spark, tiny, monkeypatch):
    """Every stage of run() on what its predecessor kept of the given documents."""
    stages = corpus_pipeline.STAGES
    kept = {}
    for n in range(1, 6):
        monkeypatch.setattr(corpus_pipeline, "STAGES", stages[:n])
        kept[n] = corpus_pipeline.run(spark, tiny)
    docs = table(spark, tiny, "documents")
    assert all(kept[n].columns == docs.columns for n in range(1, 5))
    scores = quality.score_quality(docs, table(spark, tiny, "labels")).filter("score >= 0.3")
    good = {r["doc_id"] for r in scores.collect()}
    rows = [p for p in pairs(docs) if p[0] in good]
    assert Counter(rows) == Counter(pairs(kept[1])) and len(rows) < docs.count()
    assert Counter(brute_lines(rows)) == Counter(pairs(kept[2]))
    check_survivors(pairs(kept[2]), pairs(kept[3]))
    items = [tuple(r) for r in table(spark, tiny, "benchmark").select("item_id", "text").collect()]
    items = [(str(i), t) for i, t in items]
    check_cut(pairs(kept[3]), items, pairs(kept[4]))
    for n in (2, 4):
        assert kept[n].filter("text is not null and n_chars <> char_length(text)").count() == 0
    left = pairs(kept[4])
    ids = expected_ids([t for _, t in left])
    assert check_packed(kept[5], list(zip([i for i, _ in left], ids)), packing.WINDOW) > 0.9
