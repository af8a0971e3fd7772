"""Formula programs as column expressions.

`parts` cuts a program into nodes: the formula itself, and one for each call that looks into a range (COUNTIF, SUMIF,
MATCH, INDEX, VLOOKUP, and calls that need all values of a range in order). What a node computes from single values is its shape: a tree in which numbers, texts,
references and ranges are numbered, so that formulas that differ in these only, such as those filled down a column, have one shape. `value` turns a shape into
expressions over the columns nums, texts, env (values by number of the reference) and stats (aggregates by number of the range);
`affine` gives factor and summand where a shape is linear in one of its references.

A value is a number, a text, a logical value (kept as 1 or 0) or blank; errors are texts and do not spread.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from gridlake.functions import library as L
from gridlake.functions.coerce import DIV0, NUM, VALUE, as_text
from gridlake.functions.formula import INSTRUCTION, REFERENCE, literal, parse, reference, tokens_of

#: Calls that become nodes of their own if they look into a range, and those that need the range's aggregates only.
LOOKUPS, LISTS, AGGREGATES = ("COUNTIF", "SUMIF", "MATCH", "INDEX", "VLOOKUP"), ("IRR", "XIRR", "CONCATENATE"), ("SUM", "MAX", "MIN", "AVERAGE", "COUNT", "AND", "OR")

NODE = StructType(
    [StructField(n, t) for n, t in (("k", IntegerType()), ("kind", StringType()), ("shape", StringType()), ("nums", ArrayType(DoubleType())), ("texts", ArrayType(StringType())),
                                    ("refs", ArrayType(REFERENCE)), ("parts", ArrayType(IntegerType())), ("ranges", ArrayType(REFERENCE)))]
)


class _Node:
    """Collects what a shape numbers."""

    def __init__(self, k: int, kind: str) -> None:
        self.k, self.kind = k, kind
        self.nums, self.texts, self.refs, self.parts, self.ranges = [], [], [], [], []

    def numbered(self, tree: tuple, refs: list) -> list:
        op, *rest = tree
        at = lambda held, x: held.append(x) or len(held) - 1
        if op == "num":
            return ["num", at(self.nums, rest[0])]
        if op == "text":
            return ["text", at(self.texts, rest[0])]
        if op == "ref":
            return ["ref", at(self.refs, refs[rest[0]])]
        if op == "range":
            return ["range", at(self.ranges, refs[rest[0]])]
        if op == "part":
            return ["part", at(self.parts, rest[0])]
        if op in ("op", "call"):
            return [op, rest[0], *(self.numbered(x, refs) for x in rest[1:])]
        return [op, *rest]

    def row(self, shape: list) -> dict:
        as_row = lambda r: dict(zip(REFERENCE.names, r, strict=True)) if not isinstance(r, dict) else r
        return {"k": self.k, "kind": self.kind, "shape": json.dumps(shape), "nums": self.nums, "texts": self.texts, "refs": [as_row(r) for r in self.refs], "parts": self.parts, "ranges": [as_row(r) for r in self.ranges]}


def parts(program: list[dict], refs: list[dict]) -> list[dict]:
    """The nodes of a program; the first is the formula itself."""
    out: list[dict] = []

    def scalar(tree: tuple) -> tuple:
        """A range where one value is wanted is its first cell; an operator takes it for 0."""
        if tree[0] == "range":
            return ("ref", first[tree[1]])
        return tree

    first: dict[int, int] = {}
    refs = list(refs)
    for n, r in enumerate(list(refs)):
        if r["is_range"]:
            first[n] = len(refs)
            refs.append(dict(r) | {"end_row": r["row"], "end_col": r["col"], "is_range": False})
    stack: list[tuple] = []
    for i in program:
        op, word, n = i["op"], i["text"], i["n"]
        if op in ("num", "bool"):
            stack.append((op, float(i["num"])))
        elif op == "text":
            stack.append((op, word))
        elif op == "blank":
            stack.append((op,))
        elif op == "ref":
            stack.append(("range" if refs[n]["is_range"] else "ref", n))
        else:
            args = stack[len(stack) - n :]
            del stack[len(stack) - n :]
            if op == "op":
                stack.append(("op", word, *(("num", 0.0) if a[0] == "range" else a for a in args)))
                continue
            several = any(a[0] == "range" for a in args)
            looks = word in LOOKUPS or (several and word in LISTS)
            if looks:
                node = _Node(len(out) + 1, word)
                inside = lambda a: a if a[0] == "range" else ("range", a[1])
                spots = {"COUNTIF": (0,), "SUMIF": (0, 2), "MATCH": (1,), "INDEX": (0,), "VLOOKUP": (1,)}.get(word, range(len(args)))
                args = [inside(a) if k in spots and a[0] == "ref" and word in LOOKUPS else a if k in spots else scalar(a) for k, a in enumerate(args)]
                out.append(node.row(node.numbered(("call", word, *args), refs)))
                stack.append(("part", node.k))
            else:
                stack.append(("call", word, *(a if word in AGGREGATES else scalar(a) for a in args)))
    node = _Node(0, "value")
    return [node.row(node.numbered(scalar(stack.pop()), refs)), *out]


#: What a worker remembers: nodes by the structure of a formula, with places instead of numbers, texts and references.
_STRUCTURES: dict[tuple, list[dict]] = {}
REMEMBERED = 10_000


def _structure(text: str | None) -> list[dict]:
    """The nodes of a formula with the places of its numbers (-1 less theirs), texts and references (row; `end_row` is -1, but not where a range's first cell is meant)."""
    error, program, refs = parse(text)
    if error:
        return []
    program, n, t = [dict(zip(INSTRUCTION.names, i, strict=True)) for i in program], 0, 0
    for i in program:
        if i["op"] == "num":
            i["num"], n = -1.0 - n, n + 1
        elif i["op"] == "text":
            i["text"], t = str(t), t + 1
    return parts(program, [dict(zip(REFERENCE.names, r, strict=True)) | {"row": k, "end_row": -1} for k, r in enumerate(refs)])


def nodes_of(text: str | None) -> list[dict]:
    """The nodes of a formula's text; none if it cannot be read. Formulas that differ in numbers, texts and references only are put together once."""
    try:
        tokens = tokens_of((text or "").lstrip("="))
        refs = [dict(zip(REFERENCE.names, reference(t), strict=True)) for kind, t in tokens if kind == "ref"]
    except ValueError:
        return []
    ranged = iter(refs)
    key = tuple((kind, next(ranged)["is_range"] if kind == "ref" else None if kind in ("num", "text") else t) for kind, t in tokens)
    if key not in _STRUCTURES:
        if len(_STRUCTURES) >= REMEMBERED:
            _STRUCTURES.clear()
        _STRUCTURES[key] = _structure(text)
    nums, texts = [float(t) for kind, t in tokens if kind == "num"], [literal(t) for kind, t in tokens if kind == "text"]

    def given(r: dict) -> dict:
        mine = refs[r["row"]]
        return mine if r["end_row"] < 0 else mine | {"end_row": mine["row"], "end_col": mine["col"], "is_range": False}

    return [
        x | {"nums": [nums[int(-1 - v)] if v < 0 else v for v in x["nums"]], "texts": [texts[int(v)] for v in x["texts"]], "refs": [given(r) for r in x["refs"]], "ranges": [given(r) for r in x["ranges"]]}
        for x in _STRUCTURES[key]
    ]


def _nodes(formula: pd.Series) -> pd.Series:
    return pd.Series([nodes_of(x) for x in formula], dtype=object)


#: The nodes of texts, without carrying programs from Python and back. Worked out once, as `formula.parse_formula` is.
nodes = F.pandas_udf(_nodes, ArrayType(NODE)).asNondeterministic()


# Values -------------------------------------------------------------------------------------------------------


def no_num() -> Column:
    return F.lit(None).cast("double")


def no_text() -> Column:
    return F.lit(None).cast("string")


@dataclass
class V:
    """A value: `kind` is num, bool, text or any, as far as is known before it runs."""

    num: Column
    txt: Column
    kind: str


def _num(x: Column | float) -> V:
    return V((F.lit(float(x)) if isinstance(x, int | float) else x.cast("double")), no_text(), "num")


def _bool(x: Column) -> V:
    return V(F.coalesce(x, F.lit(False)).cast("double"), no_text(), "bool")


def _text(x: Column | str) -> V:
    return V(no_num(), F.lit(x) if isinstance(x, str) else x, "text")


def _or_error(x: Column, good: Column, name: str, error: str | None = None) -> V:
    """A number, or an error where `good` does not hold."""
    good = F.coalesce(good, F.lit(False))
    return V(F.when(good, x.cast("double")), F.when(~good, F.lit(error or f"#ERROR: {name}")), "any")


def number(v: V) -> Column:
    """A text that is a number counts as it, any other and blanks as 0."""
    if v.kind in ("num", "bool"):
        return v.num
    return F.coalesce(v.num, v.txt.try_cast("double"), F.lit(0.0))


def text(v: V) -> Column:
    if v.kind == "bool":
        return F.when(v.num != 0, "True").otherwise("False")
    return as_text(v.num) if v.kind == "num" else v.txt if v.kind == "text" else F.coalesce(v.txt, as_text(v.num), F.lit(""))


def truth(v: V) -> Column:
    return v.num != 0 if v.kind in ("num", "bool") else F.coalesce(v.txt != "", v.num != 0, F.lit(False))


def compared(op: str, a: V, b: V) -> Column:
    """Texts as numbers if both are, else trimmed and in lower case; a text and a number as numbers."""
    both = a.txt.isNotNull() & b.txt.isNotNull()
    x, y = a.txt.try_cast("double"), b.txt.try_cast("double")
    low = lambda v: F.lower(F.trim(v.txt))
    by = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}[op]
    plain = by(number(a), number(b))
    if "text" not in (a.kind, b.kind) and "any" not in (a.kind, b.kind) or {a.kind, b.kind} & {"num", "bool"}:
        return plain
    return F.when(both & x.isNotNull() & y.isNotNull(), by(x, y)).when(both, by(low(a), low(b))).otherwise(plain)


def _operated(op: str, args: list[V]) -> V:
    if len(args) == 1:
        x = number(args[0])
        return _num({"-": -x, "+": x, "%": x / 100}[op])
    a, b = args
    if op == "&":
        return _text(F.concat(text(a), text(b)))
    if op in ("=", "<>", "<", ">", "<=", ">="):
        return _bool(compared(op, a, b))
    x, y = number(a), number(b)
    if op == "/":
        return _or_error(x / F.nullif(y, F.lit(0.0)), y != 0, "/", DIV0)
    if op == "^":
        return _power(x, y, "^")
    return _num({"+": x + y, "-": x - y, "*": x * y}[op])


def _power(x: Column, y: Column, name: str) -> V:
    p = F.pow(x, y)
    good = ~F.isnan(p) & (F.abs(p) < F.lit(float("inf")))
    return V(F.when(good, p), F.when(F.isnan(p) & ~F.isnan(x) & ~F.isnan(y), F.lit(NUM)).when(~good, F.lit(f"#ERROR: {name}")), "any")


def _date(v: V) -> Column:
    """A date from a serial number above 1000 or a text in one of the known forms."""
    day = L.dated(v.txt) if v.kind == "text" else F.when(v.txt.isNull(), L.of_serial(v.num)).otherwise(L.dated(v.txt))
    return F.coalesce(L.of_serial(v.num), F.lit(L.NO_DATE).cast("date")) if v.kind == "num" else F.coalesce(day, F.lit(L.NO_DATE).cast("date"))


def _datedif(args: list[V]) -> V:
    s, e = _date(args[0]), _date(args[1])
    unit = F.upper(text(args[2])) if len(args) > 2 else F.lit("D")
    out = F.lit(0)
    for u in ("D", "M", "Y", "YM", "MD", "YD"):
        out = F.when(unit == u, L.DATEDIF(s, e, u)).otherwise(out)
    return _num(out)


def _strict(v: V) -> tuple[Column, Column]:
    """A number as aggregates take it, and whether it is one: a text must be one."""
    if v.kind in ("num", "bool"):
        return v.num, F.lit(True)
    x = v.txt.try_cast("double")
    return F.coalesce(v.num, x, F.lit(0.0)), v.txt.isNull() | x.isNotNull()


def _aggregated(name: str, args: list) -> V:
    """SUM, MAX, MIN, AVERAGE, COUNT, AND, OR over single values and aggregates of ranges. Blanks count as 0."""
    n = F.lit(0).cast("double")
    total, good, texts, true = F.lit(0.0), F.lit(True), F.lit(0.0), F.lit(0.0)
    low, high = [], []
    for a in args:
        if isinstance(a, V):
            x, is_num = _strict(a)
            n, total, good, true = n + 1, total + x, good & is_num, true + truth(a).cast("double")
            texts = texts + a.txt.isNotNull().cast("double")
            low, high = [*low, x], [*high, x]
        else:
            held = lambda c, a=a: F.coalesce(a[c], F.lit(0.0))
            n, total, good, texts, true = n + held("area"), total + held("total"), good & (held("bad") == 0), texts + held("texts"), true + held("true")
            zero = F.when(held("cells") < held("area"), F.lit(0.0))
            low, high = [*low, F.least(a["lo"], zero)], [*high, F.greatest(a["hi"], zero)]
    if name == "AND":
        return _bool(true == n)
    if name == "OR":
        return _bool(true > 0)
    if name == "COUNT":
        return _num(n - texts)
    if name == "SUM":
        return _or_error(total, good, name)
    if name == "AVERAGE":
        return _or_error(total / F.nullif(n, F.lit(0.0)), good & (n > 0), name)
    ends = low if name == "MIN" else high
    best = ends[0] if len(ends) == 1 else (F.least if name == "MIN" else F.greatest)(*ends) if ends else no_num()
    return _or_error(best, good & (n > 0), name)


def _rounded(args: list[V], up: bool | None) -> V:
    x, n = number(args[0]), (number(args[1]).cast("int") if len(args) > 1 else F.lit(0))
    # Inside a lambda the argument is computed once and the generated code stays small.
    near = F.transform(F.array(F.struct(x.alias("x"), n.alias("n"))), lambda v: L.ROUND(v["x"], v["n"]))[0]
    if up is None:
        return _num(near)
    power = L.ten_to(n)
    return _num(F.when(n >= 0, (F.ceil(x * power) if up else F.floor(x * power)).cast("double") / power).otherwise(near))


def _chosen(args: list[V]) -> V:
    k, rest = number(args[0]).cast("int"), args[1:]
    pick = lambda none, side: reduce(lambda otherwise, j: F.when(k == j + 1, side(rest[j])).otherwise(otherwise), range(len(rest)), none)
    inside = (k >= 1) & (k <= len(rest))
    return V(pick(no_num(), lambda v: v.num), F.when(~inside, F.lit(VALUE)).otherwise(pick(no_text(), lambda v: v.txt)), "any")


def _if(args: list[V]) -> V:
    c, a = truth(args[0]), args[1] if len(args) > 1 else _num(0.0)
    b = args[2] if len(args) > 2 else _num(0.0)
    kind = a.kind if a.kind == b.kind else "num" if {a.kind, b.kind} == {"num", "bool"} else "any"
    return V(F.when(c, a.num).otherwise(b.num), F.when(c, a.txt).otherwise(b.txt), kind)


def _mod(args: list[V]) -> V:
    x, y = number(args[0]), number(args[1])
    m = x % F.nullif(y, F.lit(0.0))
    return _or_error(F.when((m != 0) & ((m < 0) != (y < 0)), m + y).otherwise(m), y != 0, "MOD")


def _pmt(args: list[V]) -> V:
    rate, n, pv, fv, begin = (number(a) for a in [*args, *[_num(0.0)] * (5 - len(args))])
    growth = F.pow(1 + rate, n)
    payment = -rate * (pv * growth + fv) / F.nullif((growth - 1) * (1 + rate * begin), F.lit(0.0))
    out = F.when(rate == 0, -(pv + fv) / F.nullif(n, F.lit(0.0))).otherwise(payment)
    return _or_error(out, out.isNotNull(), "PMT")


def _made_date(args: list[V]) -> V:
    d = L.DATE(*(number(a).cast("int") for a in args))
    return _or_error(L.serial(d), d.isNotNull(), "DATE")


def _edate(args: list[V]) -> V:
    return _num(L.EDATE(_date(args[0]), number(args[1]).cast("int")))


def _isblank(args: list[V]) -> V:
    v = args[0]
    return _bool(F.lit(False) if v.kind in ("num", "bool") else F.coalesce(v.txt == "", v.num.isNull()))


#: Least and greatest number of arguments, and what a call makes of them.
CALLS: dict[str, tuple[int, int, Callable[[list[V]], V]]] = {
    "ROUND": (1, 2, lambda a: _rounded(a, None)), "ROUNDUP": (1, 2, lambda a: _rounded(a, True)), "ROUNDDOWN": (1, 2, lambda a: _rounded(a, False)),
    "ABS": (1, 1, lambda a: _num(F.abs(number(a[0])))), "IF": (1, 3, _if), "NOT": (1, 1, lambda a: _bool(~truth(a[0]))),
    "POWER": (2, 2, lambda a: _power(number(a[0]), number(a[1]), "POWER")), "SQRT": (1, 1, lambda a: _or_error(F.sqrt(number(a[0])), number(a[0]) >= 0, "SQRT")),
    "MOD": (2, 2, _mod), "INT": (1, 1, lambda a: _num(L.INT(number(a[0])))), "SIGN": (1, 1, lambda a: _num(F.signum(number(a[0])))),
    "LEN": (1, 1, lambda a: _or_error(F.length(a[0].txt), a[0].txt.isNotNull(), "LEN")), "CONCATENATE": (0, 255, lambda a: _text(F.concat(F.lit(""), *map(text, a)))), "ISBLANK": (1, 1, _isblank),
    "YEAR": (1, 1, lambda a: _num(F.year(_date(a[0])))), "MONTH": (1, 1, lambda a: _num(F.month(_date(a[0])))), "DAY": (1, 1, lambda a: _num(F.dayofmonth(_date(a[0])))),
    "DATE": (3, 3, _made_date), "EDATE": (2, 2, _edate), "DATEDIF": (2, 3, _datedif), "PMT": (3, 5, _pmt), "CHOOSE": (1, 255, _chosen),
}
KNOWN = {*CALLS, *LOOKUPS, *LISTS, *AGGREGATES}


def value(tree: list) -> V:
    """Expressions for a shape, over the columns nums, texts, env, stats."""
    op, *rest = tree
    if op == "num":
        return _num(F.col("nums")[rest[0]])
    if op == "text":
        return _text(F.col("texts")[rest[0]])
    if op == "bool":
        return V(F.lit(float(rest[0])), no_text(), "bool")
    if op == "blank":
        return V(no_num(), no_text(), "any")
    if op == "ref":
        held = F.try_element_at("env", F.lit(rest[0]))
        n = F.nanvl(held["n"], F.lit(0.0))
        return V(F.when(held["s"].isNull(), F.coalesce(n, F.lit(0.0))), held["s"], "any")
    if op == "part":
        held = F.try_element_at("env", F.lit(-1 - rest[0]))
        return V(held["n"], held["s"], "any")
    if op == "held":
        return V(F.col(f"_n{rest[0]}"), no_text() if rest[1] in ("num", "bool") else F.col(f"_s{rest[0]}"), rest[1])
    if op == "op":
        return _operated(rest[0], [value(x) for x in rest[1:]])
    name, args = rest[0], rest[1:]
    if name in AGGREGATES:
        return _aggregated(name, [F.try_element_at("stats", F.lit(a[1])) if a[0] == "range" else value(a) for a in args])
    if name not in CALLS:
        return _text(f"#NAME?: {name}" if name not in KNOWN else f"#ERROR: {name}")
    least, most, made = CALLS[name]
    return made([value(a) for a in args]) if least <= len(args) <= most else _text(f"#ERROR: {name}")


def bound(trees: dict[str, list], whole: bool) -> tuple[list[dict[str, dict[str, Column]]], dict[str, list]]:
    """Columns to compute first, stage by stage, and what is left of each tree: every reference, operation and call of a tree becomes two columns (_n and _s with its
    place), so that what reads it several times does not compute it again, and expressions grow with the formula, not with the power of its depth. The
    trees share columns. A tree that is not taken `whole` keeps its outermost call."""
    stages: list[dict[str, dict[str, Column]]] = []

    def walked(tree: list, name: str, used: dict[int, int], keep: bool = False) -> tuple[list, int]:
        if tree[0] not in ("ref", "part", "op", "call"):
            return tree, 0
        below = [walked(x, name, used) for x in tree[2:]] if tree[0] in ("op", "call") else []
        tree = [*tree[:2], *(x for x, _ in below)]
        height = max([0, *(h for _, h in below)])
        if keep:
            return tree, height
        v = value(tree)
        while len(stages) <= height:
            stages.append({})
        at = f"{height}_{used.setdefault(height, 0)}"
        used[height] += 1
        stages[height].setdefault(f"_n{at}", {})[name] = v.num
        stages[height].setdefault(f"_s{at}", {})[name] = v.txt
        return ["held", at, v.kind], height + 1

    return stages, {name: walked(tree, name, {}, not whole)[0] for name, tree in trees.items()}


def refs_in(tree: list) -> set[int]:
    return {tree[1]} if tree[0] == "ref" else {k for x in tree[2:] for k in refs_in(x)} if tree[0] in ("op", "call") else set()


def affine(tree: list, unknown: int) -> tuple[Column, Column] | None:
    """Factor and summand of a shape as a function of the reference `unknown`, null where they do not exist; None if the shape is not of this form."""
    if tree == ["ref", unknown]:
        return F.lit(1.0), F.lit(0.0)
    if unknown not in refs_in(tree):
        return F.lit(0.0), number(value(tree))
    if tree[0] != "op" or tree[1] not in ("+", "-", "*", "/", "%"):
        return None
    sides = [affine(x, unknown) for x in tree[2:]]
    if None in sides:
        return None
    (a, b), op = sides[0], tree[1]
    if len(sides) == 1:
        return {"+": (a, b), "-": (-a, -b), "%": (a / 100, b / 100)}[op]
    c, d = sides[1]
    if op in ("+", "-"):
        return (a + c, b + d) if op == "+" else (a - c, b - d)
    left, right = (unknown in refs_in(x) for x in tree[2:])
    if op == "*" and not (left and right):
        return (a * d, b * d) if left else (b * c, b * d)
    if op == "/" and not right:
        by = F.nullif(d, F.lit(0.0))
        return a / by, b / by
    return None
