"""The command-line jobs, one after another on one small CSV."""

from supportlake.plans import jobs
from tests.test_jobs import ISSUES
from tests.test_sources import HEADER


def test_all_jobs(spark, tmp_path):
    lines, n = [], 0
    for copy in range(12):
        for ask, answer in ISSUES:
            n += 10
            lines.append(f'{n},c{n},True,,"@Desk {ask}, number {copy}",,\n')
            lines.append(f'{n + 1},Desk,False,,"@c{n} {answer}",,{n}.0\n')
    # The brand filter keeps the customer's rows by their mention.
    raw = tmp_path / "raw.csv"
    raw.write_text(HEADER + "".join(lines))
    out = str(tmp_path / "out")
    common = ["--raw", str(raw), "--brand", "Desk", "--out", out]
    jobs.main(["inspect", *common])
    jobs.main(["grade", *common])
    tiers = {r.tier: r.threads for r in spark.read.json(f"{out}/tiers").collect()}
    assert tiers["total"] == 48 and tiers["usable"] > 0
    threads = ["--threads", f"{out}/threads", "--out", out]
    jobs.main(["train", *threads])
    jobs.main(["golden", *threads])
    sheet = ["--sheet", f"{out}/sheet", "--out", out]
    jobs.main(["progress", *sheet])
    jobs.main(["validate", *sheet, "--expected", "48"])
    assert spark.read.json(f"{out}/progress").first().labeled == 0
    assert spark.read.json(f"{out}/faults").count() == 25
    model = ["--model", f"{out}/model"]
    jobs.main(["agent", "--raw", str(raw), *model, *threads])
    assert spark.read.json(f"{out}/decisions").count() == 48

    from pyspark.sql import functions as F

    from supportlake.sources import tables

    blank = tables.read_golden(spark, f"{out}/sheet")
    labelled = blank.withColumns(
        {"gold_intent": F.col("model_suggested_intent"), "gold_auto_or_escalate": F.lit("escalate")})
    tables.write_golden(labelled, f"{out}/labelled")
    jobs.main(["evaluate", "--sheet", f"{out}/labelled", *model, *threads])
    assert spark.read.json(f"{out}/benchmark").count() == 3
    assert spark.read.json(f"{out}/failures").count() > 0


def test_profiles_and_kept_index(spark, tmp_path, tiny):
    rows = [
        f'{n},c{n},True,,"@Desk {ask}, number {n}",,\n{n + 1},Desk,False,,"@c{n} {answer}",,{n}\n'
        for n, (ask, answer) in ((10 * i, ISSUES[i % 4]) for i in range(1, 25))
    ]
    out = str(tmp_path / "out")
    jobs.main(["profiles", "--texts", f"{tiny}/documents.parquet", "--out", f"{out}/profiles"])
    assert spark.read.parquet(f"{out}/profiles").groupBy("lang").count().count() > 2
    index, threads = f"{out}/index", ["--threads", f"{out}/threads", "--out", out]
    for upto in (12, 24):
        raw = tmp_path / f"raw{upto}.csv"
        raw.write_text(HEADER + "".join(rows[:upto]))
        common = ["--raw", str(raw), "--brand", "Desk", "--out", out]
        jobs.main(["grade", *common, "--profiles", f"{out}/profiles"])
        jobs.main(["index", *threads, "--index", index, "--buckets", "4", "--segments", "1"])
    store = jobs.CaseStore.open(spark, index)
    assert len(store.segments()) == 1 and store.manifest["n_cases"] > 12
    jobs.main(["train", *threads])
    agent = ["agent", "--raw", str(raw), "--model", f"{out}/model"]
    jobs.main([*agent, "--index", index, "--out", f"{out}/kept"])
    jobs.main([*agent, "--threads", f"{out}/threads", "--out", f"{out}/fresh"])
    kept, fresh = (
        sorted(map(str, spark.read.json(f"{out}/{x}/decisions").collect())) for x in ("kept", "fresh")
    )
    assert kept == fresh and len(kept) == 24
