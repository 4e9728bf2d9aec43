import json

import pytest

from ledgerloom.config import GREEDY, MAXFLOW
from ledgerloom.operators.ledger import aggregate_entries
from ledgerloom.plans.pipeline import reconcile_csv
from ledgerloom.sources.sinks import summary_lines, write_json_array
from ledgerloom.sources.tables import ledger_lines, read_csv

BANK = "\r\n".join(["datetime,amount,description", '1/2/24 9:05,-10.00,"Coffee, beans"', '1/3/24,20.05,"rent ""x"""', "", "2/30/24,5,bad day", "1/4/24,oops,bad amount", ""])
LEDGER = "journal_entry_id,datetime,amount,description\nA,1/2/24,4.00,coffee\nB,1/5/24,20,rent x\nA,bad,6.00,\nA,1/9/24,0,beans\n,1/1/24,7,nobody\nC,nope,1,first date is bad\nC,1/1/24,1,second\n"


@pytest.fixture
def files(tmp_path):
    bank, ledger = tmp_path / "bank.csv", tmp_path / "ledger.csv"
    bank.write_bytes(BANK.encode())
    ledger.write_text(LEDGER)
    return str(bank), str(ledger)


def test_csv(spark, files, tmp_path):
    rows = read_csv(spark, files[0]).orderBy("_row").collect()
    assert [r["_row"] for r in rows] == [0, 1, 2, 3]
    assert rows[0]["description"] == "Coffee, beans"
    odd = tmp_path / "odd.csv"
    odd.write_text('a,b,a\n1,2\n"x\ny",3,4,5\n')
    got = read_csv(spark, str(odd)).orderBy("_row").collect()
    assert [(r["a"], r["b"]) for r in got] == [(None, "2"), ("4", "3")]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "head.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path / "head.csv")).count() == 0


def test_entries(spark, files):
    got = {r["journal_entry_id"]: r for r in aggregate_entries(ledger_lines(read_csv(spark, files[1]), GREEDY), GREEDY).collect()}
    assert [(k, got[k]["gl_idx"], got[k]["gl_amount"], got[k]["gl_description"]) for k in ("A", "B", "", "C")] == [("A", 0, 10.0, "coffee beans"), ("B", 1, 20.0, "rent x"), ("", 2, 7.0, "nobody"), ("C", 3, 2.0, "first date is bad second")]
    assert got["C"]["gl_ts"] is None and got["A"]["gl_datetime"] == "1/2/24"
    other = {r["journal_entry_id"]: r for r in aggregate_entries(ledger_lines(read_csv(spark, files[1]), MAXFLOW), MAXFLOW).collect()}
    assert sorted(other) == ["A", "B", "C"] and other["C"]["gl_datetime"] == "1/1/24" and other["A"]["gl_description"] == "coffee"


def test_exact_sum(spark):
    from dataclasses import replace

    rows = spark.createDataFrame([(i, "A", None, None, v, "d") for i, v in enumerate([0.1, 0.2, 0.3])], "line_no long, journal_entry_id string, datetime string, ts timestamp_ntz, amount double, description string")
    assert aggregate_entries(rows, GREEDY).first()["gl_amount"] == 0.1 + 0.2 + 0.3
    assert aggregate_entries(rows, MAXFLOW).first()["gl_amount"] == 0.6
    assert aggregate_entries(rows, replace(GREEDY, total="decimal")).first()["gl_amount"] == 0.6


def test_totals_of_odd_amounts(spark):
    import math
    import random

    import pandas as pd

    random.seed(2)
    groups = {"large": [2e15, 5.0], "small": [0.004] * 3, "nan": [1.0, float("nan")], "inf": [1.0, float("inf"), 2.0], "none": [None, None], "holes": [1.5, None, 2.25], "many": [random.uniform(-1, 1) * 10 ** random.randint(-8, 15) for _ in range(300)]}
    lines = [(i, k, None, None, v, k) for i, (k, v) in enumerate((k, v) for k, values in groups.items() for v in values)]
    rows = spark.createDataFrame(lines, "line_no long, journal_entry_id string, datetime string, ts timestamp_ntz, amount double, description string").repartition(3)
    same = lambda a, b: a == b or (math.isnan(a) and math.isnan(b))
    got = {r["journal_entry_id"]: r["gl_amount"] for r in aggregate_entries(rows, GREEDY, number=False).collect()}
    for k, values in groups.items():
        total = 0.0
        for v in values:
            total += v or 0.0
        assert same(got[k], total), k
    assert got["large"] == 2000000000000005.0 and got["small"] == 0.012
    frame = pd.DataFrame([(r[1], r[4]) for r in lines], columns=["k", "v"]).astype({"v": float})
    want = frame[frame["k"] != "nan"].groupby("k")["v"].sum().to_dict()  # a nan is a missing value there
    got = {r["journal_entry_id"]: r["gl_amount"] for r in aggregate_entries(rows, MAXFLOW, number=False).collect()}
    assert all(same(got[k], want[k]) for k in want)


def test_end_to_end(spark, files, tmp_path):
    done = reconcile_csv(spark, *files)
    out = tmp_path / "matches.json"
    assert write_json_array(done.records, str(out)) == 2
    records = json.loads(out.read_text())
    assert [(r["journal_entry_id"], r["bank_index"]) for r in records] == [("A", 0), ("B", 1)]
    assert records[0]["score"] == 1.0 and '"gl_amount": 10.00' in out.read_text()
    assert summary_lines(done.summary.first())[2:4] == ["Matched:           2", "Bank match rate:   50.0%"]
    strict = reconcile_csv(spark, *files, config=MAXFLOW)
    assert strict.records.count() == 1  # 20.05 is too far from 20 at a tolerance of 0.01


def test_stream_equals_batch(spark, files, tmp_path):
    from ledgerloom.streaming.ingest import bank_stream, candidate_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("bank_id,datetime,amount,description\n0,1/2/24,-10.00,coffee\n1,1/3/24,20.05,rent\n")
    aggregate_entries(ledger_lines(read_csv(spark, files[1]), GREEDY), GREEDY).write.parquet(str(tmp_path / "entries"))
    entries = spark.read.parquet(str(tmp_path / "entries"))
    query = candidate_stream(bank_stream(spark, str(folder), GREEDY), entries, GREEDY).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r["bank_idx"], r["gl_idx"]) for r in spark.table("pairs").collect()) == [(0, 0), (1, 1)]


def _split(line):
    """Fields by one pass: a quote opens or closes quoted text, two within it are one."""
    out, cur, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"' and quoted and line[i + 1 : i + 2] == '"':
            cur, i = cur + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out, cur = out + [cur], ""
        else:
            cur += c
        i += 1
    return out + [cur]


def test_records_split_like_one_pass(spark):
    import random

    from ledgerloom.sources.tables import split_record

    random.seed(3)
    lines = ['x"1,2"y,3', ',,', '""', '"""x', 'a"b"",""c"d,e', "", '"a","b"", c",d', "x" * 5000 + '","' + 'y"' * 900] + ["".join(random.choice('ab,"" ') for _ in range(random.randint(0, 14))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, s string")
    got = {r["i"]: r["f"] for r in rows.select("i", split_record(rows.s).alias("f")).collect()}
    for i, line in enumerate(lines):
        assert got[i] == _split(line), line


def test_csv_in_splits(spark, tmp_path):
    """A file of several splits keeps its order; its header comes again as a row like any other."""
    path = tmp_path / "long.csv"
    path.write_text("k,v\n" + "".join(f'{i},"a{i}, b"c\n' for i in range(20_000)) + "k,v\n\nlast,1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_csv(spark, str(path)).orderBy("_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["_row"] for r in rows] == list(range(20_002))
    assert [(r["k"], r["v"]) for r in rows[:2] + rows[-2:]] == [("0", "a0, bc"), ("1", "a1, bc"), ("k", "v"), ("last", "1")]


def test_missing_columns_and_text_rules(spark, tmp_path):
    from dataclasses import replace

    from ledgerloom.sources.tables import bank_rows

    path = tmp_path / "few.csv"
    path.write_text("amount\n5\n\n7x\n")
    raw = read_csv(spark, str(path))
    bank = {r["bank_idx"]: r for r in bank_rows(raw, GREEDY).collect()}
    assert [(bank[i]["bank_amount"], bank[i]["bank_description"], bank[i]["bank_ts"]) for i in (0, 1)] == [(5.0, "", None), (7.0, "", None)]
    assert sorted((r["journal_entry_id"], r["amount"]) for r in ledger_lines(raw, GREEDY).collect()) == [("0", 5.0), ("1", 7.0)]
    holes = tmp_path / "holes.csv"
    holes.write_text("datetime,amount,description\n1/2/24,5,\n")
    raw = read_csv(spark, str(holes))
    assert bank_rows(raw, MAXFLOW).first()["bank_description"] is None
    assert bank_rows(raw, replace(MAXFLOW, nan_text=True)).first()["bank_description"] == "nan"


def test_main(spark, files, tmp_path, monkeypatch, capsys):
    from ledgerloom.plans.pipeline import main

    out = tmp_path / "out.json"
    assert main([*files, "--out", str(out)]) == 0
    assert [r["journal_entry_id"] for r in json.loads(out.read_text())] == ["A", "B"] and "Matched:           2" in capsys.readouterr().out
    assert main([*files, "--preset", "maxflow", "--strategy", "grouped", "--out", str(out)]) == 0 and len(json.loads(out.read_text())) == 1
    capsys.readouterr()
    assert main([files[0], str(tmp_path / "nowhere.csv")]) == 1 and "Cannot open" in capsys.readouterr().err
    empty = tmp_path / "nothing.csv"
    empty.write_text("")
    assert main([str(empty), files[1]]) == 1 and "Empty input" in capsys.readouterr().err
    # One path alone does not override the defaults.
    monkeypatch.chdir(tmp_path)
    with monkeypatch.context() as m:
        seen = []
        m.setattr("ledgerloom.plans.pipeline.reconcile_csv", lambda spark, *a: seen.append(a) or (_ for _ in ()).throw(ValueError("stop")))
        assert main([files[0]]) == 1
        assert seen[0][:2] == ("bank_transactions.csv", "general_ledger.csv")


def test_unrounded_json(spark, files, tmp_path):
    done = reconcile_csv(spark, *files, config=MAXFLOW)
    out = tmp_path / "raw.json"
    write_json_array(done.records, str(out), rounded=False)
    [record] = json.loads(out.read_text())
    assert list(record) == ["journal_entry_id", "gl_datetime", "gl_amount", "gl_description", "bank_index", "bank_datetime", "bank_amount", "bank_description", "score"]
    assert record["gl_amount"] == 10.0 and 0 < record["score"] < 1
