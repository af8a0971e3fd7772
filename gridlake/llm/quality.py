"""Quality rules: base counts of a text, and lines that many documents of one host share.

Lines are normalised (lower case, digits to 0, white space to single spaces, trimmed) and hashed. For each
host (the source of a document) the distinct documents with a line are counted; `once_a_text` counts documents with one
text once instead. A line above the limit is removed: `min_docs` documents or `max_share` of the host's distinct documents,
whichever is more, but never more than `most_docs`, so that a line cannot hide in a very large host. A document is
depleted, and rejected, if fewer than `min_left` of its words remain. Documents that fail the base rules are
rejected whatever their lines are.

Each text is read once; its counts and the hashes of its lines are written to a table that all further steps read. Only
hashes and counts are shuffled, pre-aggregated by task, so a common line costs at most one row for each task and
document. Hashes have 64 bits.

Cases: a document is an id with its text, so rows that repeat both are one document, and two texts with one id, or
without, are two. Each row is judged by its own lines. A null text has no words and fails the base rules. Null hosts are one
host. Lines without words are not counted. Equal lines inside a document count once. An empty table gives an empty one. Of the
input only the id, text and host columns are used; `without_boilerplate` keeps all, under any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridlake.llm.common import SPACES, boxed, cut, unboxed, word_array, word_count

#: Words of a window that may repeat; limits of the base rules.
WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 0.2
#: A line is boilerplate on its host above this many distinct documents and this share of them, or above MOST_DOCS.
MIN_DOCS, MAX_SHARE, MOST_DOCS, MIN_LEFT = 10, 0.02, 1000, 0.5


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACES, " "))


@F.pandas_udf(LongType())
def repeated_words(words: pd.Series) -> pd.Series:
    """How many words stand in a window of five that occurs twice or more in the text, given the words' hashes."""
    out = np.zeros(len(words), "i8")
    for k, w in enumerate(words):
        n = len(w) - WINDOW + 1
        if n < 2:
            continue
        w = w.view("u8")
        h = np.zeros(n, "u8")
        for j in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if not same.any():
            continue
        covered = np.zeros(n + WINDOW, "i4")
        starts = np.zeros(n, bool)
        starts[order[1:][same]] = True
        starts[order[:-1][same]] = True
        covered[:n] += starts
        covered[WINDOW:] -= starts
        out[k] = (np.cumsum(covered)[: len(w)] > 0).sum()
    return pd.Series(out)


def _counted(docs: DataFrame, text_col: str, others: dict[str, Column]) -> DataFrame:
    """`others`, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = docs.select(
        *[e.alias(c) for c, e in others.items()],
        word_array(text).alias("_words"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    ).select(
        *others,
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.transform("_words", lambda w: F.xxhash64(w))).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    return _counted(docs, text_col, {id_col: docs[id_col]})


def _keys(docs: DataFrame, id_col: str, text_col: str, host_col: str, once_a_text: bool) -> dict[str, Column]:
    """host and document as hashes, and the document's lines with words: their hash and number of words, each occurrence."""
    host = F.xxhash64(F.coalesce(F.concat(F.lit("h"), docs[host_col]), F.lit("null")))
    doc = F.xxhash64(docs[text_col]) if once_a_text else F.xxhash64(docs[id_col], docs[text_col])
    line = lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), word_count(x).alias("words"))
    lines = F.filter(F.transform(F.split(F.coalesce(docs[text_col], F.lit("")), "\n"), line), lambda x: x["words"] > 0)
    return {"host": host, "doc": doc, "lines": lines}


def _boilerplate(measured: DataFrame, min_docs: int, max_share: float, most_docs: int) -> DataFrame:
    """host, line of lines above the limit. `measured` has host, doc and lines."""
    hosts = measured.select("host", "doc").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    seen = measured.select("host", "doc", F.explode(F.array_distinct("lines.line")).alias("line")).distinct()
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    limit = F.least(F.greatest(F.lit(float(min_docs)), max_share * F.col("docs")), F.lit(float(most_docs)))
    return counts.where(F.col("n") > min(min_docs, most_docs)).join(hosts, "host").where(F.col("n") > limit).select("host", "line")


def line_frequency(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    most_docs: int = MOST_DOCS,
    min_left: float = MIN_LEFT,
    once_a_text: bool = False,
) -> DataFrame:
    """The base counts of each document with n_removed_words, depleted and kept."""
    others = {"id": docs[id_col], "row": F.monotonically_increasing_id(), **_keys(docs, id_col, text_col, host_col, once_a_text)}
    measured = cut(_counted(docs, text_col, others))
    lines = measured.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    hit = lines.join(_boilerplate(measured, min_docs, max_share, most_docs), ["host", "line"], "left_semi")
    removed = hit.groupBy("row").agg(F.sum("words").alias("removed"))
    rows = measured.drop("host", "doc", "lines").join(removed, "row", "left").drop("row").withColumnRenamed("id", id_col)
    rows = rows.withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long")).drop("removed")
    depleted = (F.col("n_words") - F.col("n_removed_words")) < min_left * F.col("n_words")
    return rows.withColumn("depleted", depleted).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def without_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    most_docs: int = MOST_DOCS,
    once_a_text: bool = False,
) -> DataFrame:
    """The documents with the lines above the limit taken out of their texts, all other columns as they are."""
    measured = cut(docs.select(*[e.alias(c) for c, e in _keys(docs, id_col, text_col, host_col, once_a_text).items()]))
    lines = measured.select("host", "doc", F.explode("lines.line").alias("line"))
    hit = lines.join(_boilerplate(measured, min_docs, max_share, most_docs), ["host", "line"], "left_semi")
    # A document's lines to take out are bounded by that document.
    gone = hit.groupBy("host", "doc").agg(F.collect_set("line").alias("gone"))
    kept = [c for c in docs.columns if c != text_col]
    keys = _keys(docs, id_col, text_col, host_col, once_a_text)
    rows = docs.select(boxed(docs, kept).alias("box"), docs[text_col].alias("text"), keys["host"].alias("host"), keys["doc"].alias("doc"))
    rows = rows.join(gone, ["host", "doc"], "left")
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normalised(x))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    others = dict(zip(kept, unboxed("box", kept), strict=True))
    return rows.select(*[text.alias(c) if c == text_col else others[c] for c in docs.columns])


SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('h' || source, 'null') AS host,
          coalesce(doc_id::varchar, '') || '.' || coalesce(md5(text), '') AS doc FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS s
        FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range({WINDOW}) o(j) GROUP BY r),
raw_lines AS (SELECT r, host, doc, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, host, doc, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{SPACES}', ' ', 'g'), ' ') AS norm,
                 len(list_filter(regexp_split_to_array(line, '{SPACES}'), lambda x: x <> '')) AS words
          FROM raw_lines WHERE regexp_replace(line, '{SPACES}', '', 'g') <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT host, count(DISTINCT doc) AS docs FROM d GROUP BY host),
often AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc) AS n FROM lines GROUP BY host, norm) JOIN hosts USING (host)
          WHERE n > least(greatest({MIN_DOCS}, {MAX_SHARE}::double * docs), {MOST_DOCS})),
gone AS (SELECT r, sum(words) AS n FROM lines JOIN often USING (host, norm) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::bigint AS n_words, length(regexp_replace(text, '{SPACES}', '', 'g'))::bigint AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint AS n_symbols, coalesce(dup.n, 0)::bigint AS n_dup_lines,
             coalesce(rep.n, 0)::bigint AS n_repeat_words, coalesce(gone.n, 0)::bigint AS n_removed_words
      FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_removed_words,
       n_words - n_removed_words < {MIN_LEFT}::double * n_words AS depleted,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - n_removed_words < {MIN_LEFT}::double * n_words) AS kept
FROM m
"""
