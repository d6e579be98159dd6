from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.operators import threads
from supportlake.sources import messages as m
from supportlake.sources import tables

HEADER = "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
ROWS = [
    '1,c1,True,Tue Oct 31 22:10:47 +0000 2017,"@ShopDesk my parcel, is late",2,\n',
    '2,ShopDesk,False,Tue Oct 31 22:11:47 +0000 2017,"We are\nlooking into it",,1.0\n',
    "oops,c1,True,,not a number,,1\n",
    "3,c2,true,,hello @shopdesker,,\n",
    "4,c3,False,,nothing here,,x\n",
    "5,shopdesk,False,,lower case author,,3\n",
    "3,c2,true,,second version @shopdesk,,\n",
]


def csv(tmp_path, rows=ROWS, name="raw.csv"):
    path = tmp_path / name
    path.write_text(HEADER + "".join(rows), encoding="utf-8")
    return str(path)


def test_tolerant_scan(spark, tmp_path):
    raw = m.read_messages_csv(spark, csv(tmp_path))
    got = {r.ord: r for r in m.coerce_messages(raw).collect()}
    assert sorted(got) == [0, 1, 3, 4, 5, 6]
    assert got[1].parent_id == 1 and "\n" in got[1].text
    assert got[0].inbound and got[3].inbound and not got[4].inbound
    assert got[4].parent_id is None
    last = {r.tweet_id: r.text for r in m.last_version(m.coerce_messages(raw)).collect()}
    assert last[3] == "second version @shopdesk" and len(last) == 5


def test_row_cap_counts_raw_rows(spark, tmp_path):
    raw = m.read_messages_csv(spark, csv(tmp_path), max_rows=3)
    assert sorted(r.tweet_id for r in m.coerce_messages(raw).collect()) == [1, 2]


def test_file_order_over_several_files(spark, tmp_path):
    for i in range(3):
        rows = [f"{10 * i + j},c,True,,text {j},,\n" for j in range(4 + i)]
        csv(tmp_path, rows, f"part{i}.csv")
    got = m.read_messages_csv(spark, str(tmp_path) + "/part*.csv").orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(15))
    assert [int(r.tweet_id) for r in got] == [*range(4), *range(10, 15), *range(20, 26)]


def scanned(frame):
    """Rows in order, without the place itself."""
    return [tuple(r)[:-1] for r in frame.orderBy("ord").collect()]


def test_scan_equals_the_numbered_reader(spark, tmp_path):
    rows = list(ROWS) + [
        '9,c9,True,,"three\n\nlines, ""quoted"" ",,\n', '10,c9,True,,"",,\n', "   \n",
        '11,c9,True,,"ends\n',  # goes on in the next line, with what looks like a row
        '12,c1,True,,no row,,\n', 'here",,\n', "13,c9,True,,é 日本,,12.0\n",
    ]
    for i in range(3):
        csv(tmp_path, rows if i != 1 else ROWS[2:], f"part{i}.csv")
    path = str(tmp_path) + "/part*.csv"
    expected = scanned(m.read_messages_csv(spark, path))
    assert len(expected) == 29
    assert scanned(m.scan_messages_csv(spark, path)) == expected
    for n in (0, 1, 7, 13, 28, 29, 50):
        assert scanned(m.scan_messages_csv(spark, path, n)) == expected[:n]


def test_records_across_splits(spark, tmp_path):
    """Splits of a few bytes: records begin, go on and end in different ones."""
    rows = [
        f'{i},c,True,,"{"x" * (i % 7)}' + "\nmore, text" * (i % 4) + '",,\n' for i in range(120)
    ]
    path = csv(tmp_path, rows)
    expected = scanned(m.read_messages_csv(spark, path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        assert scanned(m.scan_messages_csv(spark, path)) == expected
        assert m.file_audit(spark, path).first().total_records == 120
        plain = csv(tmp_path, [r.replace("\nmore, text", "") for r in rows], "plain.csv")
        expected = scanned(m.read_messages_csv(spark, plain, multi_line=False))
        assert scanned(m.scan_messages_csv(spark, plain)) == expected
        assert scanned(m.scan_messages_csv(spark, plain, 61)) == expected[:61]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_scan_and_cut_move_no_rows(spark, tmp_path):
    path = csv(tmp_path, [r for r in ROWS if "\n" not in r[:-1]])
    for frame in (m.scan_messages_csv(spark, path), m.scan_messages_csv(spark, path, 3)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(200_000).select((F.col("id") * 7).alias("ord"))
    cut = m.first_rows(rows, 70_001)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.agg(F.count("*"), F.max("ord")).first()[:] == (70_001, 490_000)


def test_golden_sheet_is_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "g")
    columns = ", ".join(f"{c} string" for c in packs.GOLDEN_COLUMNS)
    values = [[f"{i}-{c}" for c in packs.GOLDEN_COLUMNS] for i in range(9)]
    values[3][2] = "a\nb"
    tables.write_golden(spark.createDataFrame(values, columns).repartition(1), path)
    sheet = tables.read_golden(spark, path, numbered=True)
    changed = sheet.withColumn("gold_intent", F.concat(F.lit("new "), F.col("gold_intent")))
    tables.write_golden(changed, path)
    again = tables.read_golden(spark, path, numbered=True).orderBy("idx").collect()
    assert [r.gold_intent for r in again] == [
        "new " + v[packs.GOLDEN_COLUMNS.index("gold_intent")] for v in values
    ]
    assert [p.name for p in tmp_path.iterdir()] == ["g"]

    def fails(new):
        raise RuntimeError("disk full")

    try:
        tables.replace_folder(spark, path, fails)
    except RuntimeError:
        pass
    assert tables.read_golden(spark, path).count() == 9


def test_corrupt_thread_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "quality_label=usable").mkdir()
    (tmp_path / "quality_label=usable" / "x.json").write_text('{"thread_id": "1", "messages": []}\n{"thread\n')
    rows = tables.read_threads(spark, str(tmp_path), corrupt=True).collect()
    assert sorted((r.thread_id or "", r._corrupt_record or "") for r in rows) == [("", '{"thread'), ("1", "")]


def test_brand_filters(spark, tmp_path):
    rows = m.coerce_messages(m.read_messages_csv(spark, csv(tmp_path)))
    strict = sorted(r.ord for r in m.brand_filter(rows, "ShopDesk", strict=True).collect())
    loose = sorted(r.ord for r in m.brand_filter(rows, "ShopDesk").collect())
    assert strict == [0, 1, 3, 6] and loose == [0, 1, 3, 5, 6]


def test_extract_keeps_existing_output(spark, tmp_path):
    rows = m.coerce_messages(m.read_messages_csv(spark, csv(tmp_path)))
    out = str(tmp_path / "brand")
    assert m.extract_brand(rows, "ShopDesk", out, max_rows=2).count() == 2
    assert m.extract_brand(rows, "nobody", out).count() == 2


def test_audit_counts_lines_and_records(spark, tmp_path):
    row = m.file_audit(spark, csv(tmp_path)).first()
    assert row.total_lines == 9 and row.total_rows == 8 and row.total_records == 7
    assert row.file_size_bytes > 0 and row.file_size_mb == 0.0


def test_created_at_and_profile(spark, tmp_path):
    raw = m.read_messages_csv(spark, csv(tmp_path))
    first = raw.orderBy("ord").select(m.parse_created_at(F.col("created_at")).alias("t")).first()
    assert str(first.t) == "2017-10-31 22:10:47"
    profile = {r.column_name: r for r in m.column_profile(raw, True).collect()}
    assert profile["created_at"].nulls == 5 and profile["text"].approx_distinct == 7
    assert m.head_sample(raw, 2).count() == 2


def test_author_volume(spark, tmp_path):
    rows = m.coerce_messages(m.read_messages_csv(spark, csv(tmp_path)))
    got = [(r.brand_author_id, r.tweet_volume) for r in m.top_authors(rows, 2).collect()]
    assert got == [("ShopDesk", 1), ("c3", 1)]


def test_nested_threads_round_trip(spark, tmp_path):
    turns = spark.createDataFrame(
        [("7", 1, 7, "c", "customer", None, "hi"), ("7", 2, 8, "b", "brand", None, "é \n x")],
        "thread_id string, turn_no bigint, tweet_id bigint, author_id string, speaker string, "
        "created_at string, text string",
    )
    graded = spark.createDataFrame([("7", "usable", "why")], "thread_id string, tier string, reason string")
    nested = threads.nest_threads(turns, graded, "b")
    tables.write_threads(nested, str(tmp_path / "t"))
    back = tables.read_threads(spark, str(tmp_path / "t"))
    assert back.first().quality_label == "usable"
    again = threads.unnest_threads(back).orderBy("turn_no").collect()
    assert [r.text for r in again] == ["hi", "é \n x"] and again[1].turn_no == 2


def test_golden_sheet_round_trip(spark, tmp_path):
    values = [str(i) for i in range(len(packs.GOLDEN_COLUMNS))]
    values[2], values[3] = 'says "no",\nthen leaves', ""
    rows = spark.createDataFrame([tuple(values)], ", ".join(f"{c} string" for c in packs.GOLDEN_COLUMNS))
    tables.write_golden(rows, str(tmp_path / "g"))
    assert tuple(tables.read_golden(spark, str(tmp_path / "g")).first()) == tuple(values)
