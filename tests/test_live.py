"""A model kept up to date by batches of edits equals one that is evaluated anew."""

from gridlake.operators import evaluate as E
from gridlake.operators import live

KIND = "sheet string, row int, col_ix int, v_num double, v_str string, formula_raw string"
EDITS = "id string, v_num double, v_str string"


def book(spark):
    rows = []
    for r in range(1, 5):
        rows.append(("S", r, 1, r + 1.0, None, None))
        rows.append(("S", r, 2, None, None, f"=MIN(A{r},3)"))
        rows.append(("S", r, 3, None, None, f"=SUM(B$1:B{r})+MAX(A$1:A{r})"))
    rows += [("S", 1 + k, 4, None, None, f) for k, f in enumerate(["=C4*2+COUNT(A1:A4)", "=IF(SUM(A1:A4)>0,1,2)", "=D2+1"])]
    return E.with_ids(spark.createDataFrame(rows, KIND))


def values(df):
    return {r.id: (r.v_num, r.v_str) for r in df.collect()}


def test_edits_equal_evaluation_and_stop_where_nothing_moves(spark, monkeypatch):
    monkeypatch.setattr(live, "HELD", 4)
    model = live.Live(book(spark))
    step, seen = E._step, []
    for batch in ([("S!4!1", 4.5, None), ("S!9!9", 1.0, None)], [("S!2!1", 1.0, None), ("S!3!1", None, "text")]):
        before = values(model.cells)
        monkeypatch.setattr(E, "_step", lambda m, todo, v: seen.extend(r.id for r in todo.collect()) or step(m, todo, v))
        changes = {r.id: ((r.old_num, r.old_str), (r.new_num, r.new_str)) for r in model.apply(spark.createDataFrame(batch, EDITS)).collect()}
        monkeypatch.setattr(E, "_step", step)
        now = values(model.cells)
        assert now == values(E.evaluate(model.cells))
        edited = {i for i, _, _ in batch}
        assert changes == {k: (before[k], now[k]) for k in now if before[k] != now[k] and k not in edited}
        if "S!9!9" in edited:
            # MIN(A4, 3) and the sign of the sum stay, so nothing above them is computed.
            assert sorted(seen) == ["S!1!4", "S!2!4", "S!4!2", "S!4!3"]
