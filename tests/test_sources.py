"""Workbooks, stores, items, questions, diffs, streams."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from gridlake.operators import diff as D
from gridlake.operators import evaluate as E
from gridlake.operators import items as I
from gridlake.operators import resolve as R
from gridlake.sources import store, xlsx
from gridlake.streaming import edits

BOOK = {
    "参数输入表": {"B2": "类别", "D2": "参数", "I2": "数值", "B3": "基本参数", "D4": "建设期长度", "I4": 5, "J4": "年", "D5": "总投资额度", "I5": "=I4*100", "J5": "万元", "D6": "2024", "I6": 1},
    "利润表": {"B5": 1, "C5": "营业收入", "D5": ("=SUM(F5:H5)", 60), "E5": "万元", "F5": ("=参数输入表!I4", 5), "G5": ("=F5*2", 10), "H5": ("=G5*2", 20), "C6": "合计", "D6": 3, "B8": True, "C8": dt.date(2023, 3, 15)},
    "时间序列": {"B3": "投资计划", "D3": 1, "E3": 2, "F3": 3},
}


def book(spark, tmp_path):
    path = str(tmp_path / "model.xlsx")
    digest = xlsx.write_workbook(path, BOOK, {"利润表": ["B5:C5"]})
    return path, digest, xlsx.read_workbook(spark, path)


def test_workbook_to_cells(spark, tmp_path):
    path, digest, cells = book(spark, tmp_path)
    got = {r.cell_id: r for r in cells.collect()}
    assert len(got) == sum(map(len, BOOK.values())) and cells.rdd.getNumPartitions() == 3
    assert got["利润表_5_D"].formula_raw == "=SUM(F5:H5)" and got["利润表_5_D"].v_num == 60 and got["利润表_5_D"].data_type == "formula"
    assert got["利润表_5_B"].is_merged and got["利润表_5_B"].merge_range == "B5:C5" and got["利润表_5_C"].is_merged and got["利润表_5_C"].merge_range is None
    assert got["利润表_8_B"].data_type == "boolean" and got["利润表_8_C"].v_date == dt.date(2023, 3, 15) and got["利润表_8_C"].data_type == "date"
    assert xlsx.file_hashes(spark, path).first().file_hash == digest


def test_shared_formulas_move():
    assert xlsx._shift('A1+$B$2+C$3&"A1"', 2, 1) == 'B3+$B$2+D$3&"A1"'
    assert [xlsx.letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]


def test_workbook_to_values_and_items(spark, tmp_path):
    _, _, cells = book(spark, tmp_path)
    values = {r.id: r.v_num for r in E.evaluate(E.with_ids(cells)).collect()}
    assert values["参数输入表!5!9"] == 500 and values["利润表!5!8"] == 20 and values["利润表!5!4"] == 35
    got = {r.name: r for r in I.items(cells).collect()}
    assert set(got) == {"建设期长度", "总投资额度", "营业收入", "投资计划"}
    assert got["建设期长度"].section == "基本参数" and got["总投资额度"].unit == "万元" and got["总投资额度"].formula_source == "=I4*100"
    assert (got["营业收入"].ts_start, got["营业收入"].ts_end, got["营业收入"].unit) == (6, 8, "万元")
    assert [(r.pos, r.v_num) for r in I.series(I.items(cells), cells).where("item_id LIKE '%时间序列%'").orderBy("pos").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert {(r.sheet, r.col_ix): r.n_formula for r in I.profile(cells).collect()}["利润表", 6] == 1


def test_merged_ranges_are_swept():
    rng = random.Random(2)
    boxes, taken = [], set()
    for _ in range(400):
        r, c, h, w = rng.randint(1, 60), rng.randint(1, 30), rng.randint(0, 9), rng.randint(0, 4)
        cells = {(y, x) for y in range(r, r + h + 1) for x in range(c, c + w + 1)}
        if not cells & taken:
            taken |= cells
            boxes.append((r, c, r + h, c + w))
    merged = xlsx.MergedCells(boxes)
    order = [(y, x) for y in range(1, 75) for x in range(1, 40)]
    assert all(merged.holds(*at) == (at in taken) for at in order)
    assert all(merged.holds(*at) == (at in taken) for at in rng.sample(order, 500))
    # Ten thousand ranges cost no more than the cells and the ranges.
    tall = xlsx.MergedCells([(2 * k + 1, 1, 2 * k + 2, 3) for k in range(10_000)])
    start = time.perf_counter()
    assert sum(tall.holds(y, x) for y in range(1, 20_001) for x in range(1, 6)) == 60_000
    assert time.perf_counter() - start < 20


def test_noise_names(spark):
    names = ["ab", "2024", "ABC", "1,234.5", "2024-01-02 x", "第3年", "还款第3年", "5.", "营业收入", None, "2024年3月末自动取时点"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", I.is_noise(F.col("n")).alias("x")).collect()
    assert [r.n for r in got if not r.x] == ["第3年", "营业收入"]


def test_questions(spark):
    asked = ["营业收入是多少？", "2025年营业收入是多少", "如果总投资增加10，净利润会怎样", "资本金和贷款的对比", "建设期"]
    got = [r.i for r in spark.createDataFrame([(q,) for q in asked], "q string").select(R.intent(F.col("q")).alias("i")).collect()]
    assert [g.kind for g in got] == ["value", "value", "what_if", "compare", "other"] and [g.entity for g in got] == ["营业收入", "营业收入", "总投资", "资本金", "建设期"]
    assert got[1].year == 2025 and got[2].action == "增加" and got[2].amount == 10 and got[3].other == "贷款"
    asked = ["2025年第3季度收入是多少", "2026年二季度的营业成本为多少", "2025年收入是多少"]
    got = [r.i for r in spark.createDataFrame([(q,) for q in asked], "q string").select(R.intent(F.col("q")).alias("i")).collect()]
    assert [(g.entity, g.year, g.quarter, g.period) for g in got] == [("收入", 2025, "3", "2025Q3"), ("营业成本", 2026, "2", "2026Q2"), ("收入", 2025, None, "2025")]
    names = spark.createDataFrame([("建设期长度",), ("营业收入合计",), ("其他",)], "name string")
    found = R.fuzzy(spark.createDataFrame([("建设期",), ("营业收入",), ("完全无关",)], "entity string"), names)
    assert {r.entity: r.name for r in found.collect()} == {"建设期": "建设期长度", "营业收入": "营业收入合计"}


def test_versions(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "id long, v double")
    new = spark.createDataFrame([(2, 5.0), (3, None), (4, 4.0)], "id long, v double")
    one, back = D.diff(old, new, ["id"], ["v"]), D.diff(new, old, ["id"], ["v"])
    assert {r.id: r.status for r in one.collect()} == {1: "removed", 2: "modified", 3: "unchanged", 4: "added"}
    a, b = D.summary(one, "a", "b").first(), D.summary(back, "b", "a").first()
    assert (a.added, a.removed, a.modified) == (b.removed, b.added, b.modified) and a.summary == "a vs b: +1 / -1 / ~1 (1 unchanged)"
    assert D.summary(D.diff(old, old, ["id"], ["v"]), "a", "a").first().total_changes == 0
    assert D.last_by(spark.createDataFrame([("x", 1), ("x", 2)], "name string, k int"), ["name"], "k").first().k == 2


def test_registry(spark):
    when = dt.datetime(2024, 1, 1)
    new = spark.createDataFrame([("a.xlsx", "h1", when), ("b.xlsx", "h2", when), ("c.xlsx", "h1", when)], "filename string, file_hash string, upload_time timestamp")
    one = store.add_uploads(store.empty_registry(spark), new)
    two = store.update_upload(store.add_uploads(one, new), 2, status="done", cell_count=7)
    assert sorted((r.id, r.filename, r.status, r.cell_count) for r in two.collect()) == [(1, "a.xlsx", "pending", None), (2, "b.xlsx", "done", 7)]
    assert [r.id for r in store.uploads(two, 1).collect()] == [2]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "cell", "{}"), ("b", "business_item", None), ("c", None, None)], store.NODE)
    edges = spark.createDataFrame([("a", "b", None, None, "value", None), ("a", "zz", "DEPENDS_ON", "x", None, None)], store.EDGE)
    store.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = store.load_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and {r.relation for r in e.collect()} == {"DEPENDS_ON"}
    assert '"id":"a"' in store.one_document(nodes, edges).first().json
    batches = store.property_graph(n.where("type = 'cell'"), n.where("type <> 'cell'"), e, str(tmp_path / "p"), 1)
    assert batches == 3 and spark.read.parquet(str(tmp_path / "p" / "edges")).count() == 1


def test_stream_of_edits(spark, tmp_path):
    rows = [("S", 1, 1, 5.0, None, None), ("S", 1, 2, 10.0, None, "=A1*2"), ("S", 1, 3, 11.0, None, "=B1+1")]
    model = edits.Model(E.with_ids(spark.createDataFrame(rows, "sheet string, row int, col_ix int, v_num double, v_str string, formula_raw string")))
    kind = "id string, v_num double, v_str string, ts timestamp"
    first = spark.createDataFrame([("S!1!1", 6.0, None, dt.datetime(2024, 1, 1)), ("S!1!1", 7.0, None, dt.datetime(2024, 1, 2))], kind)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = edits.follow(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), model, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r.id: r.new_num for r in seen} == {"S!1!2": 14, "S!1!3": 15}
    assert {r.id: r.v_num for r in model.cells.collect()} == {"S!1!1": 7, "S!1!2": 14, "S!1!3": 15}


def test_activity_counts_late_events_out(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    assert edits.activity(batch).agg(F.sum("n")).first()[0] == batch.count()
