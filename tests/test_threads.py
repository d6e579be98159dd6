import random

from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.functions.rules import java_regex
from supportlake.functions.text import clean_text, language_words, ngrams, strip_handles, tokens
from supportlake.operators import quality, threads

SCHEMA = (
    "tweet_id bigint, author_id string, inbound boolean, created_at string, text string, "
    "parent_id bigint, ord bigint"
)
P = packs.SUPPORT


def messages(spark, rows):
    """(id, by_brand, parent[, text])."""
    out = []
    for i, r in enumerate(rows):
        text = r[3] if len(r) > 3 else f"text {r[0]}"
        out.append((r[0], "Desk" if r[1] else f"c{r[0]}", not r[1], None, text, r[2], i))
    return spark.createDataFrame(out, SCHEMA)


def brute_walk(rows):
    ids = {r[0]: r for r in rows}
    first = {}
    for r in rows:
        if r[2] is not None:
            first.setdefault(r[2], r[0])
    out = {}
    for r in rows:
        if not r[1] and (r[2] is None or r[2] not in ids):
            cur, turn = r[0], 1
            while cur in ids:
                out[cur] = (r[0], turn)
                cur, turn = first.get(cur), turn + 1
    return out


def walked(spark, rows):
    got = threads.walk(messages(spark, rows)).collect()
    return {r.tweet_id: (r.root_id, r.turn_no) for r in got}


def test_branches_orphans_and_cycles(spark):
    rows = [
        (1, False, None), (2, True, 1), (3, True, 1), (4, False, 2),
        (10, False, 99), (11, True, 10),  # root whose parent is not in the set
        (20, True, None), (21, False, 20),  # hangs below a brand message: no root
        (30, False, 31), (31, False, 30),  # cycle
        (40, False, None),
    ]
    assert walked(spark, rows) == brute_walk(rows)
    turns = threads.thread_turns(messages(spark, rows), "Desk")
    assert {r.thread_id for r in turns.collect()} == {"1", "10"}


def test_first_reply_is_first_in_file_order(spark):
    rows = [(1, False, None), (9, True, 1), (2, True, 1)]
    assert walked(spark, rows)[9] == (1, 2) and 2 not in walked(spark, rows)


def test_random_forests_and_row_order(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1, 300):
        parent = rng.choice([None, rng.randrange(1, 320), max(1, i - 1)])
        rows.append((i, rng.random() < 0.4, parent if parent != i else None))
    rows = [r for r in rows if r[2] is None or r[2] < r[0] or r[2] > 299]
    expected = brute_walk(rows)
    assert walked(spark, rows) == expected
    shuffled = messages(spark, rows).orderBy(F.md5(F.col("tweet_id").cast("string")))
    got = threads.walk(shuffled).collect()
    assert {r.tweet_id: (r.root_id, r.turn_no) for r in got} == expected


def test_deep_chain_and_wide_parent(spark):
    deep = [(1, False, None)] + [(i, i % 2 == 0, i - 1) for i in range(2, 130)]
    wide = [(1000, False, None)] + [(1000 + i, True, 1000) for i in range(1, 200)]
    got = walked(spark, deep + wide)
    assert got[129] == (1, 129) and got[1001] == (1000, 2) and 1002 not in got
    fan = threads.reply_fanout(messages(spark, wide)).first()
    assert fan.n_replies == 199 and fan.primary_child == 1001


def graded(spark, turns, **options):
    rows = []
    for tid, msgs in turns.items():
        for i, (who, text) in enumerate(msgs, 1):
            rows.append((tid, i, int(tid) * 100 + i, who, who, None, text))
    frame = spark.createDataFrame(
        rows,
        "thread_id string, turn_no bigint, tweet_id bigint, author_id string, speaker string, "
        "created_at string, text string",
    )
    ends = threads.thread_endpoints(frame).withColumn("detected", F.lit("en"))
    out = quality.grade_threads(ends, P, **({"language": "detected"} | options))
    return {r.thread_id: (r.tier, r.reason) for r in out.collect()}


C, B = "customer", "brand"
PROBLEM = (C, "@Desk the parcel was left outside in the rain")


def test_grading_matrix(spark):
    long_ = "Please go to your account and choose the order"
    assert len(long_) == 46
    got = graded(
        spark,
        {
            "1": [PROBLEM],
            "2": [PROBLEM, (C, "anyone there at all?")],
            "3": [(C, "@Desk help"), (B, "what is it")],
            "4": [PROBLEM, (B, "We checked it"), (C, "Thanks, it worked!")],
            "5": [PROBLEM, (B, "We checked it"), (C, "Thanks but I will go elsewhere")],
            "6": [PROBLEM, (B, "Your replacement sent today")],
            "7": [PROBLEM, (B, long_ + "....")],
            "8": [PROBLEM, (B, long_ + ".....")],
            "9": [PROBLEM, (B, "Please send us a DM")],
            "10": [PROBLEM, (B, "see https://t.co/abc"), (C, "ok then I did that")],
            "11": [PROBLEM, (B, "Could you tell us more?")],
            "12": [PROBLEM, (B, "Refund processed, see https://t.co/xyz")],
            "13": [(C, "please help me"), (B, "what is it")],
            "14": [(C, "????????????"), (B, "what is it")],
        },
    )
    assert got["1"] == (packs.UNUSABLE, packs.REASON_SINGLE_TURN)
    assert got["2"] == (packs.UNUSABLE, packs.REASON_ONE_SIDED)
    for t in ("3", "13", "14"):
        assert got[t] == (packs.UNUSABLE, packs.REASON_TRIVIAL)
    assert got["4"][0] == packs.USABLE and got["6"][0] == packs.USABLE
    assert got["5"] == (packs.PARTIAL, packs.REASON_UNANSWERED)
    assert got["7"] == (packs.PARTIAL, packs.REASON_UNCONFIRMED)  # 50 characters
    assert got["8"][0] == packs.USABLE  # 51
    assert got["9"] == got["10"] == got["12"] == (packs.PARTIAL, packs.REASON_DEFLECTED)
    assert got["11"] == (packs.PARTIAL, packs.REASON_UNCONFIRMED)


def test_older_grading(spark):
    turns = {
        "1": [PROBLEM, (B, "ok"), (C, "Thanks but I will go elsewhere")],
        "2": [(C, "Hallo, wir haben ein Problem"), (B, "ok")],
        "3": [PROBLEM, (B, "Hola amigo, un momento")],
    }
    got = graded(spark, turns, confirmation="plain", language="keyword")
    assert got["1"] == (packs.USABLE, packs.REASON_USABLE_PLAIN)
    assert got["2"] == got["3"] == (packs.UNUSABLE, packs.REASON_LANGUAGE_KEYWORD)


def test_language_gate_branches(spark):
    rows = [
        ("ok fine", "de", True), ("añadir ya", "en", False), ("wo ist das paket", "de", False),
        ("wher is my pakage", "nl", True), ("the box came late", "en", True),
        ("one two three", None, True), ("eins zwei für", None, False),
    ]
    df = spark.createDataFrame(rows, "t string, lang string, want boolean")
    gate = quality.short_text_gate(F.col("t"), P.common_words, F.col("lang"))
    for r in df.select("t", "want", gate.alias("got")).collect():
        assert r.got == r.want, r.t


def test_confirmation_examples(spark):
    rows = [
        ("Thanks, it worked!", True), ("Thanks for trying but I will order elsewhere", False),
        ("No resolution provided... Thanks alot", False), ("It won't work, thanks", False),
        ("It won’t work, thanks", True),
    ]
    df = spark.createDataFrame(rows, "t string, want boolean")
    for r in df.select("t", "want", quality.confirmed(F.col("t"), P).alias("got")).collect():
        assert r.got == r.want, r.t


def test_rule_boundaries(spark):
    policy, deflect = P.flags["policy_instruction"], P.flags["deflection"]
    rows = [
        ("settings > x", policy, False), ("settings >x", policy, True),
        ("select 'return for refund' now", policy, False),
        ("select 'return for refund'now", policy, True),
        ("éDM", deflect, False), ("DM é", deflect, True), ("dmé", deflect, False),
        ("x https://t.co/aB1", deflect, True), ("TICKET #77", P.flags["completed_action"], True),
        ("ticketing", P.flags["completed_action"], False),
    ]
    for text, alts, want in rows:
        got = spark.range(1).select(F.lit(text).rlike(java_regex(alts)).alias("x")).first().x
        assert got == want, text


def test_text_functions(spark):
    df = spark.createDataFrame([("  @josé_1 see https://x.y/z?a=1\n\tnow  ",)], "t string")
    row = df.select(
        clean_text(F.col("t")).alias("a"), strip_handles(F.col("t")).alias("b"),
        language_words(F.col("t")).alias("w"),
    ).first()
    assert row.a == "see now" and row.b.startswith("see") and row.w == ["see", "now"]
    grams = (
        spark.createDataFrame([("A bb the cc_1 dd",), ("x",)], "t string")
        .select(tokens(F.col("t"), ["the"]).alias("k"))
        .select(ngrams("k", 1, 3).alias("g"))
        .collect()
    )
    assert grams[0].g == ["bb", "cc_1", "dd", "bb cc_1", "cc_1 dd", "bb cc_1 dd"]
    assert grams[1].g == []


def test_resolution_status(spark):
    rows = [
        ("1", "please DM us", "brand", "please DM us"), ("2", "ok", "customer", "all fixed"),
        ("3", "Glad to hear it", "brand", "Glad to hear it"), ("4", "hm", "brand", "hm"),
    ]
    ends = spark.createDataFrame(
        rows, "thread_id string, last_brand_text string, last_speaker string, last_text string"
    )
    got = {r.thread_id: (r.resolved, r.resolution) for r in quality.resolution_status(ends, P).collect()}
    assert got["1"] == got["2"] == (False, packs.NOTE_REDIRECTED)
    assert got["3"] == (True, "Glad to hear it") and got["4"] == (False, packs.NOTE_OPEN)
    share = {r.resolved: (r.threads, r.pct) for r in quality.resolution_share(
        quality.resolution_status(ends, P)).collect()}
    assert share == {True: (1, 25.0), False: (3, 75.0)}


def test_distribution_keeps_empty_tiers(spark):
    df = spark.createDataFrame([("usable",), ("usable",)], "tier string")
    got = {r.tier: (r.threads, r.pct) for r in quality.quality_distribution(df).collect()}
    assert got == {
        "usable": (2, 100.0), "partially_usable": (0, 0.0), "unusable": (0, 0.0), "total": (2, 100.0),
    }


def test_graded_texts_lie_once(spark, monkeypatch):
    """Columns with the same text share it in the written table, and read as they were."""
    from supportlake.plans import support

    written, write = [], support.materialize
    monkeypatch.setattr(support, "materialize", lambda *a: written.append(write(*a)) or written[-1])
    rows = [(1, "x", "x", "y"), (2, None, "x", None), (3, "", None, ""), (4, None, None, None)]
    texts = spark.createDataFrame(rows, "id int, a string, b string, c string")
    out = support._each_text_once(texts, "t", ("a", "b", "c"))
    assert sorted(map(tuple, out.collect())) == rows and out.columns == texts.columns
    assert {r.id: r.texts_ for r in written[0].collect()} == {
        1: ["x", "y"], 2: [None, "x"], 3: ["", None], 4: [None]}
