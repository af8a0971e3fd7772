"""Personal data: base patterns, and candidates selected by boosted trees.

Base spans come from four patterns (leftmost, not overlapping within a kind) and a check of each match.
Beside them, loose generators propose overlapping candidates of each kind. Boosted trees score a candidate by
its format (digits, separators, checksum, octets, domain) and its context (neighbouring characters, words
before it). They are trained here, on all candidates: one that largely coincides with a base span of its kind
is a positive example. What defines the base patterns most narrowly (the plus of a telephone number, exact
separators) is not a feature, so the trees pass look-alikes on. A threshold calibrated to a precision on
these examples selects candidates; those that overlap no base span, and no better candidate, are added.

Everything on the way from table to spans is DataFrame expressions. Examples are counted by combination of
the yes-or-no features; only these counts (at most MOST_COMBINATIONS of them, the commonest) reach the
driver, where the trees are fitted, and the trees come back as CASE expressions.

The patterns match what the plain forms in FIXED match, but without backtracking: repeated groups are
possessive, and a match may not start inside a run whose start has failed already, so long runs of letters or
digits cost linear time and no stack. Spans are placed and compared piece by piece, which costs the number of spans to the power of 1.5.

Cases: a null text is empty and has no spans. Texts are searched whole; positions are code points, ends
exclusive. Repeated rows give repeated results; an empty table gives an empty one. `find` returns the id and
results only; `redact` keeps the input's columns, and clashing names cannot arise.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import boxed, unboxed

KINDS = ("email", "ip", "card", "phone")
# The base patterns as stated. Parts of an ip are at most 255, a card has 13 to 19 digits and
# passes Luhn's check, a phone has 9 to 15 digits.
FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches without backtracking. A match starts where a run starts, or where the last match ended.
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose forms of each kind.
LOOSE = {
    "email": r"(?<![^\s<>()\[\],;:\"'])[^\s<>()\[\],;:\"'@]{1,64}+(?:@|\(at\)|\[at\])[^\s<>()\[\],;:\"'@]{3,255}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[.:-][0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+(])\(?[0-9]{2,4}+\)?[\x20./-]?[0-9]{2,4}+(?:[\x20./-][0-9]{2,5}+){1,3}+(?![0-9])",
}
#: A text without this holds nothing of the kind.
HINT = {"email": r"@|[(\[]at[)\]]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
BEFORE = 24  # code points before a candidate that are searched for words
TOLD_BY = r"(?i)\b(?:tel|telefon|phone|fax|call|mobile|mail|e-mail|contact|card|visa|ip|host|addr|address|von|from)\b"

#: At most so many feature combinations, the commonest, are brought to the driver.
MOST_COMBINATIONS = 20_000
ROUNDS, DEPTH, RATE, PRECISION = 12, 3, 0.4, 0.95

SPAN = "array<struct<start:int,end:int,s:string,before:string,after:string>>"
Tree = tuple | float


def _chunks(items: Column) -> Column:
    """An array cut into about as many pieces as each has elements, so that what costs the square of a piece costs n ** 1.5 in all."""
    each = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), each)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(items, at, each))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def spans_of(text: Column, pattern: str, hint: str | None = None) -> Column:
    """All matches with their positions, and with what stands before and after them: what stands between matches is split off and
    measured. Positions are summed up piece by piece."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.length

    def placed(gaps: Column, found: Column) -> Column:
        """start, end, s, before, after from the matches and what stands before each of them and after the last one."""
        pair = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, s: F.struct(gap.alias("gap"), s.alias("s"), (size(gap) + size(s)).alias("n")))

        def spans(pairs: Column) -> Column:
            def step(at: Column, x: Column) -> Column:
                end = at["pos"] + x["n"]
                span = F.struct((end - size(x["s"])).alias("start"), end.alias("end"))
                return F.struct(end.alias("pos"), F.concat(at["out"], F.array(span)).alias("out"))

            none = F.array().cast("array<struct<start:int,end:int>>")

            def summed(chunks: Column) -> Column:
                offsets = F.aggregate(
                    chunks, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
                    lambda at, c: F.struct(F.aggregate(c, at["pos"], lambda p, x: p + x["n"]).alias("pos"), F.concat(at["out"], F.array(at["pos"])).alias("out")),
                )["out"]
                return F.flatten(F.zip_with(chunks, offsets, lambda c, o: F.aggregate(c, F.struct(o.alias("pos"), none.alias("out")), step)["out"]))

            places = _bound(_chunks(pairs), summed)
            around = lambda k: F.try_element_at(pairs, k)
            # Context reaches over the match before, and for what follows to the next match.
            before = lambda i: F.concat(F.coalesce(around(F.nullif(i, F.lit(0)))["gap"], F.lit("")), F.coalesce(around(F.nullif(i, F.lit(0)))["s"], F.lit("")), around(i + 1)["gap"])
            after = lambda i: F.concat(F.coalesce(F.try_element_at(gaps, i + 2), F.lit("")), F.coalesce(around(i + 2)["s"], F.lit("")))
            return F.transform(places, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), around(i + 1)["s"].alias("s"), F.right(before(i), F.lit(BEFORE)).alias("before"), F.left(after(i), F.lit(1)).alias("after")))

        return _bound(pair, spans)

    pieces = F.split(text, pattern, -1)
    out = _bound(F.struct(pieces.alias("gaps"), found.alias("found")), lambda x: placed(x["gaps"], x["found"]))
    return F.when(text.rlike(hint or pattern), out).otherwise(F.array().cast(SPAN))


def _against(items: Column, others: Column, f) -> Column:
    """f(item, those of `others` that may overlap it) for each item. Both have start and end; items in order of their starts meet few others, as those
    that a piece of them cannot overlap are left out for all of the piece."""

    def piece(chunk: Column) -> Column:
        start, end = F.array_min(F.transform(chunk, lambda x: x["start"])), F.array_max(F.transform(chunk, lambda x: x["end"]))
        sides = F.struct(start.alias("start"), end.alias("end"))
        near = _bound(sides, lambda w: F.filter(others, lambda o: (o["start"] < w["end"]) & (w["start"] < o["end"])))
        return _bound(near, lambda few: F.transform(chunk, lambda x: f(x, few)))

    return F.flatten(F.transform(_chunks(items), piece))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def luhn(s: Column) -> Column:
    """Luhn's check of the digits of a short string."""
    d = digits(s)

    def add(total: Column, k: Column) -> Column:
        x = F.substring(F.reverse(d), k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    n = F.length(digits(s))
    return {
        "email": F.lit(True),
        "ip": s.rlike(IP),
        "card": F.when(n.between(13, 19), luhn(s)).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def base_spans(text: Column) -> dict[str, Column]:
    def valid(kind: str):
        return lambda x: _valid(kind, x["s"])

    return {k: F.filter(spans_of(text, LINEAR[k], "@" if k == "email" else "[0-9]"), valid(k)) for k in KINDS}


def _features(kind: str, c: Column) -> dict[str, Column]:
    """Yes-or-no features of a candidate's format and context."""
    s, n, before, after = c["s"], F.length(digits(c["s"])), c["before"], c["after"]
    return {
        **{f"is_{k}": F.lit(k == kind) for k in KINDS},
        **{f"digits_{m}": n >= m for m in (7, 9, 11, 13, 16, 20)},
        "luhn": F.when(n.between(8, 19), luhn(s)).otherwise(False) if kind == "card" else F.lit(False),
        "octets": F.regexp_replace(s, "[:-]", ".").rlike(IP) if kind == "ip" else F.lit(False),
        "domain": s.rlike(r"(?:@|at.)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$") if kind == "email" else F.lit(False),
        "spaced": s.contains(" "),
        "dashed": s.contains("-"),
        "in_brackets": s.contains("("),
        "same_digits": s.rlike(r"^([0-9])(?:[^0-9]*\1)*[^0-9]*$"),
        "glued_before": before.rlike(r"[\p{L}0-9_=\"'/.]$"),
        "glued_after": after.rlike(r"[\p{L}0-9_=\"'/@]"),
        "told": before.rlike(TOLD_BY),
    }


def _candidates(text: Column, kind: str, base: Column) -> Column:
    """Loose matches with features and: is it an example of its kind, does any base span overlap it."""

    def full(c: Column, near: Column) -> Column:
        def shared(b: Column) -> Column:
            return F.least(b["end"], c["end"]) - F.greatest(b["start"], c["start"])

        def united(b: Column) -> Column:
            return F.greatest(b["end"], c["end"]) - F.least(b["start"], c["start"])

        features = [e.alias(n) for n, e in _features(kind, c).items()]
        good = F.exists(near, lambda b: shared(b) * 2 >= united(b))
        return F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), *features, good.alias("good"))

    return _bound(spans_of(text, LOOSE[kind], HINT[kind]), lambda found: _against(found, base, full))


FEATURES = [
    *(f"is_{k}" for k in KINDS),
    *(f"digits_{m}" for m in (7, 9, 11, 13, 16, 20)),
    *("luhn", "octets", "domain", "spaced", "dashed", "in_brackets", "same_digits", "glued_before", "glued_after", "told"),
]


def fit_trees(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[list[Tree], float]:
    """Boosted trees for the log-odds of `good`, from feature combinations (rows of yes or no) and their
    counts, and the threshold."""
    n = good + bad
    score = np.zeros(len(n))
    trees: list[Tree] = []

    def grow(rows: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int) -> Tree:
        s, b = slope[rows].sum(), bend[rows].sum()
        leaf = float(RATE * s / (b + 1.0))
        if not depth or len(rows) < 2:
            return leaf
        best, choice = 1e-6, None
        for f in range(x.shape[1]):
            yes = x[rows, f]
            s1, b1 = slope[rows][yes].sum(), bend[rows][yes].sum()
            gain = s1**2 / (b1 + 1) + (s - s1) ** 2 / (b - b1 + 1) - s**2 / (b + 1)
            if gain > best and yes.any() and not yes.all():
                best, choice = gain, f
        if choice is None:
            return leaf
        yes = x[rows, choice]
        return (choice, grow(rows[yes], slope, bend, depth - 1), grow(rows[~yes], slope, bend, depth - 1))

    def apply(tree: Tree, rows: np.ndarray, out: np.ndarray) -> None:
        if isinstance(tree, tuple):
            yes = x[rows, tree[0]]
            apply(tree[1], rows[yes], out)
            apply(tree[2], rows[~yes], out)
        else:
            out[rows] += tree

    every = np.arange(len(n))
    for _ in range(ROUNDS if len(n) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(every, good - n * p, n * p * (1 - p), DEPTH))
        apply(trees[-1], every, score)
    return trees, threshold_of(score, good, bad)


def threshold_of(score: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The least score at which the calibrated probability reaches PRECISION; infinite if nowhere. The
    calibration is isotonic: neighbouring scores are pooled until the share of good ones never falls as the
    score rises. A pool counts one bad example more than it has, so rare look-alikes are not trusted."""
    pools: list[list[float]] = []  # least score, good, all
    for k in np.argsort(score, kind="stable"):
        if pools and pools[-1][0] == score[k]:
            pools[-1][1] += good[k]
            pools[-1][2] += good[k] + bad[k]
        else:
            pools.append([score[k], good[k], good[k] + bad[k]])
    stack: list[list[float]] = []
    for pool in pools:
        stack.append(pool)
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            _, g, n = stack.pop()
            stack[-1][1] += g
            stack[-1][2] += n
    return min((float(p[0]) for p in stack if p[1] >= PRECISION * (p[2] + 1)), default=float("inf"))


def tree_expression(tree: Tree, c: Column) -> Column:
    if isinstance(tree, tuple):
        return F.when(c[FEATURES[tree[0]]], tree_expression(tree[1], c)).otherwise(tree_expression(tree[2], c))
    return F.lit(tree)


def _proposed(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """_kept (the columns `keep`, in a struct so that no name clashes), _text, base_<kind> and cand_<kind> arrays."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(boxed(docs, keep).alias("_kept"), docs[text_col].alias("_text"))
    rows = rows.select("*", *[e.alias(f"base_{k}") for k, e in base_spans(text).items()])
    return rows.select("*", *[_candidates(text, k, F.col(f"base_{k}")).alias(f"cand_{k}") for k in KINDS])


def train(docs: DataFrame, text_col: str = "text") -> tuple[list[Tree], float]:
    """Trees and threshold from the candidates of all documents."""
    cands = _proposed(docs, text_col, []).select(F.explode(F.concat(*[f"cand_{k}" for k in KINDS])).alias("c")).select("c.*")
    counts = cands.groupBy(*FEATURES).agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad")
    )
    rows = counts.orderBy(F.desc(F.col("n_good") + F.col("n_bad")), *FEATURES).limit(MOST_COMBINATIONS).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], bool).reshape(len(rows), len(FEATURES))
    good, bad = (np.array([r[c] for r in rows], float) for c in ("n_good", "n_bad"))
    return fit_trees(x, good, bad)


def _named(kind: str):
    return lambda b: F.struct(F.lit(kind).alias("kind"), b["start"].alias("start"), b["end"].alias("end"))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _judged(docs: DataFrame, text_col: str, keep: list[str], model: tuple[list[Tree], float]) -> DataFrame:
    """_kept (see `_proposed`), _text, base and spans: arrays of struct<kind, start, end>, by kind as listed, then start."""
    trees, threshold = model
    rows = _proposed(docs, text_col, keep)
    named = [F.transform(f"base_{k}", _named(k)) for k in KINDS]
    score = lambda c: reduce(lambda a, b: a + b, [tree_expression(t, c) for t in trees], F.lit(0.0))
    scored = F.transform(
        F.concat(*[f"cand_{k}" for k in KINDS]),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), score(c).alias("score")),
    )
    rows = rows.select("_kept", "_text", F.concat(*named).alias("base"), scored.alias("_scored"))
    likely = F.filter("_scored", lambda c: c["score"] >= threshold)
    free = _bound(likely, lambda found: _against(found, F.col("base"), lambda c, near: F.struct(c.alias("c"), F.exists(near, lambda b: _overlaps(b, c)).alias("taken"))))
    by_start = F.array_sort(F.transform(F.filter(free, lambda x: ~x["taken"]), lambda x: F.struct(x["c"]["start"].alias("start"), x["c"]["end"].alias("end"), x["c"]["kind"].alias("kind"), x["c"]["score"].alias("score"))))
    rows = rows.select("_kept", "_text", "base", by_start.alias("_chosen"))
    rank = lambda c: F.struct(-c["score"], c["start"], -c["end"], c["kind"])
    beaten = _against(F.col("_chosen"), F.col("_chosen"), lambda c, near: F.struct(c.alias("c"), F.exists(near, lambda o: _overlaps(o, c) & (rank(o) < rank(c))).alias("beaten")))
    best = F.transform(F.filter(beaten, lambda x: ~x["beaten"]), lambda x: x["c"])
    order = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    added = F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    every = F.array_sort(F.transform(F.concat("base", added), order))
    return rows.select(
        "_kept", "_text", "base", F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple | None = None) -> DataFrame:
    """id, n_<kind> of base spans, base_sha256, spans, n_added."""
    rows = _judged(docs, text_col, [id_col], model or train(docs, text_col))

    def of(kind: str):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        *unboxed("_kept", [id_col]), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, text_col: str = "text", model: tuple | None = None) -> DataFrame:
    """The input with each span, or run of overlapping spans, replaced by its first one's kind in brackets."""
    kept = [c for c in docs.columns if c != text_col]
    rows = _judged(docs, text_col, kept, model or train(docs, text_col))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(from_: Column, piece: Column):
        """Puts a span into the piece of the text that starts at `from_`."""

        def put(at: Column, s: Column) -> Column:
            start, end = s["start"] - from_, s["end"] - from_
            gap = F.substring(piece, at["pos"] + 1, start - at["pos"])
            out = F.when(start >= at["pos"], F.concat(at["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(at["out"])
            return F.struct(out.alias("out"), F.greatest(at["pos"], end).alias("pos"))

        return put

    def several(at: Column, chunk: Column) -> Column:
        """The text up to the last end of some spans, cut out once for all of them."""
        end = F.greatest(at["pos"], F.array_max(F.transform(chunk, lambda s: s["end"])))
        piece = F.substring(F.col("_text"), at["pos"] + 1, end - at["pos"])
        put = _bound(piece, lambda p: F.aggregate(chunk, F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")), step(at["pos"], p))["out"])
        return F.struct(F.concat(at["out"], put).alias("out"), end.alias("pos"))

    done = F.aggregate(_chunks(by_start), F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")), several,
                       lambda at: F.concat(at["out"], F.substring(F.col("_text"), at["pos"] + 1, F.length("_text"))))
    text = F.when(F.size("spans") > 0, done).otherwise(F.col("_text"))
    others = dict(zip(kept, unboxed("_kept", kept), strict=True))
    return rows.select(*[text.alias(c) if c == text_col else others[c] for c in docs.columns])
