"""Items, their edges, whole graphs and questions on small workbooks."""

import difflib
import itertools

from pyspark.sql import functions as F

from gridlake.functions import formula
from gridlake.operators import build as B
from gridlake.operators import evaluate as E
from gridlake.operators import items as I
from gridlake.operators import resolve as R
from gridlake.sources import store

KIND = "sheet string, row int, col_ix int, v_num double, v_str string, formula_raw string"


def cells(spark, sheet, content):
    rows = []
    for ref, v in content.items():
        _, row, col, *_ = formula.reference(ref)
        text = v if isinstance(v, str) else None
        raw = bool(text) and text.startswith("=")
        rows.append((sheet, row, col, None if text else float(v), None if raw else text, text if raw else None))
    return E.with_ids(spark.createDataFrame(rows, KIND))


def test_third_row_tells_parameter_sheets(spark):
    head, plain = cells(spark, "Sheet1", {"D3": "参数", "D4": "电价水平", "I4": 0.4}), cells(spark, "Sheet2", {"D4": "参数", "C3": "电价"})
    table = cells(spark, "成本表", {"D3": "参数"})
    got = {r.sheet: r.kind for r in I.kinds(head.unionByName(plain).unionByName(table)).collect()}
    assert got == {"Sheet1": "parameter", "Sheet2": "table", "成本表": "table"}
    assert [(r.name, r.value_cell) for r in I.items(head).collect()] == [("电价水平", "Sheet1!4!9")]


def test_parameters_sections_and_edges(spark):
    sheet = cells(spark, "参数输入", {
        "D1": "参数", "B2": "投资部分", "J2": "万元", "D3": "静态总投资", "I3": 100, "J3": "万元", "D4": "数据来源", "I4": 1, "D5": "建设期长度", "I5": "text",
        "B6": "not a section", "E6": 4, "D6": "运营期长度", "I6": "=I3/5",
    })
    found = I.items(sheet)
    assert sorted((r.name, r.section, r.unit, r.value_cell) for r in found.collect()) == [
        ("运营期长度", "投资部分", None, "参数输入!6!9"), ("静态总投资", "投资部分", "万元", "参数输入!3!9"),
    ]
    edges = I.item_edges(found).collect()
    assert sorted((r.source, r.target, r.role) for r in edges if r.relation == "BELONGS_TO") == [
        ("参数输入!3!4", "BI_参数输入_3", "name"), ("参数输入!3!9", "BI_参数输入_3", "value"), ("参数输入!6!4", "BI_参数输入_6", "name"), ("参数输入!6!9", "BI_参数输入_6", "value"),
    ]
    assert {(r.source, r.target) for r in edges if r.relation == "PART_OF_SECTION"} == {("参数输入!3!4", "SECTION_投资部分"), ("参数输入!6!4", "SECTION_投资部分")}


def test_graph_of_a_workbook(spark):
    g = B.build(cells(spark, "成本", {"C1": "燃料成本", "D1": 5, "E1": "=D1*2", "F1": "=E1+(", "A9": "=Z1+AB9"}))
    depend = {(r.source, r.target) for r in g.edges.where("relation = 'DEPENDS_ON'").collect()}
    assert depend == {("成本!1!5", "成本!1!4"), ("成本!1!6", "成本!1!5")}
    assert {r.type: r["count"] for r in g.nodes.groupBy("type").count().collect()} == {"cell": 5, "business_item": 1}
    empty = B.build(E.with_ids(spark.createDataFrame([], KIND)))
    assert empty.nodes.isEmpty() and empty.edges.isEmpty()


def test_what_if_finds_nothing(spark):
    sheet = cells(spark, "成本表", {"C1": "燃料成本", "D1": 5, "E1": 6})
    assert R.what_if("燃料成本是多少", I.items(sheet), sheet).isEmpty() and R.what_if("如果没有这个变为3，", I.items(sheet), sheet).isEmpty()


def test_versions_and_comparisons(spark):
    uploads = spark.createDataFrame([(7, "g")], "id long, graph_path string")
    none = spark.createDataFrame([], store.VERSION)
    v = store.add_version(store.add_version(store.add_version(none, uploads, 7, "a"), uploads, 7, "b"), uploads, 8, "c")
    assert sorted((r.id, r.upload_id, r.version_name, r.graph_path) for r in v.collect()) == [(1, 7, "a", "g"), (2, 7, "b", "g")]
    c = store.add_comparison(spark.createDataFrame([], store.COMPARISON), v, 1, 2, "d")
    assert [(r.id, r.version_a, r.version_b) for r in store.add_comparison(c, v, 1, 9, "e").collect()] == [(1, 1, 2)]


def test_letters_of_columns(spark):
    assert spark.createDataFrame([("A",), ("Z",), ("AB",)], "c string").select(B._column(F.col("c")).alias("n")).collect() == [(1,), (26,), (28,)]


def test_fuzzy_misses_no_name(spark):
    words = ["".join(x) for n in (1, 2, 3) for x in itertools.product("ab成", repeat=n)] + ["营业收入", "入", "营业成本合计", "aabbaab成成", "x", ""]
    asked = ["a", "成", "ab", "b成a", "收入", "入营", "成本", "zz", "aabb", "x收", ""]
    for least in (0.35, 0.4, 0.8):
        got = R.fuzzy(spark.createDataFrame([(q,) for q in asked], "entity string"), spark.createDataFrame([(w,) for w in words], "name string"), least)
        want = {}
        for q in asked:
            best = min((-difflib.SequenceMatcher(None, q, w).ratio(), w.encode()) for w in words if w)
            if q and -best[0] > least:
                want[q] = best[1].decode()
        assert {r.entity: r.name for r in got.collect()} == want


def test_names_are_compared_only_where_one_is_missing(spark, monkeypatch):
    """F8: an entity that an item is named by is not held against all names."""
    names = spark.createDataFrame([("Alpha",), ("Beta",)], "name string")
    asked = lambda *xs: spark.createDataFrame([(x,) for x in xs], "entity string")
    assert {(r.entity, r.name) for r in R.named(asked("Alpha", "Betta"), names).collect()} == {("Alpha", "Alpha"), ("Betta", "Beta")}
    monkeypatch.setattr(R, "fuzzy", None)
    assert [(r.entity, r.name) for r in R.named(asked("Alpha"), names).collect()] == [("Alpha", "Alpha")]
