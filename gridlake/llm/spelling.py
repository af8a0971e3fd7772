"""Spelling variants: words one edit apart, grouped under the frequent form, by dynamic programming over sorted lists.

`vocabulary` counts words: runs of letters, lower-cased in A-Z, of which a fixed share loses one code point (a planted
misspelling, by the checksum of the document's id and the word). Each task counts its own before anything is shuffled.

`near_words` finds all pairs of words that differ by one inserted, deleted or replaced code point. Two such words, the shorter
of m code points, have their first m // 2 or their last m // 2 code points in common, so words meet in groups by these (by the
length m, too); a group of more than GROUP words is split again by halves of what remains, until it is small or
nothing is left to halve. So no group is compared as a whole and none is cut off. A pair belongs to one group only: where it has the prefix in
common it is found there, and in the group of the suffix it is passed over.

In a group the words are sorted, and every word is held against the sorted list by an edit matrix of which only the band of
three diagonals is kept. Words that are adjacent share a prefix, as their LCP says; the rows of the matrix for this prefix are computed once for the
whole range of words that has it, and only what follows is computed anew. A range whose row exceeds one edit everywhere is skipped,
however many words it holds. All words of many groups take the step to the next code point together, as arrays.

Cases: null and empty texts have no words; a null id counts as an empty text in the checksum. Repeated rows count again, as the same
word in two documents does. Words without near words have n_near 0 and no form. Ties between forms go to the word that is first in
code-point order. An empty table gives an empty one. Other columns are not read, whatever their names are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import cut, discard

# Fixed values of the contract: what a word is, which runs lose a code point, how long and frequent words are, and how much more frequent a form is.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
EVERY, SHORTEST, LEAST, TIMES = 199, 6, 5, 5
_LOWER = {c: c + 32 for c in range(65, 91)}

#: Words of a group at most, unless nothing of them is left to halve; words that one task holds at once; distinct words that a task counts before it sends them on.
GROUP, HELD, COUNTED = 20_000, 20_000, 200_000


def word_of(doc_id: object, run: str) -> str:
    """What a run counts as: lower-cased, and without one code point if its checksum says so."""
    word = run.translate(_LOWER)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % EVERY:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of SHORTEST code points or more and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                for found, n in Counter(RUN.findall(text.as_py() or "")).items():
                    # No run gets longer, so shorter ones need no checksum.
                    if len(found) >= SHORTEST and len(word := word_of(doc_id.as_py(), found)) >= SHORTEST:
                        held[word] += n
                if len(held) >= COUNTED:
                    yield sent()
        yield sent()

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _entry(m: Column, a: Column, b: Column, guard: Column) -> Column:
    """The place of a word in a group: the shorter length of its pairs, how many code points of the start and the end all have in
    common, and the common start from which on pairs belong to another group."""
    return F.struct(m.cast("int").alias("m"), a.cast("int").alias("a"), b.cast("int").alias("b"), guard.cast("int").alias("guard"))


def _halved(word: Column, m: Column, a: Column, b: Column, guard: Column) -> Column:
    """The two places of a word after halving what a group leaves open."""
    h = F.floor((m - a - b) / 2)
    return F.array(_entry(m, a + h, b, guard), _entry(m, a, b + h, F.least(guard, a + h)))


def _keyed(rows: DataFrame) -> DataFrame:
    """word, n, m, a, b, guard, key: the key tells groups apart by what their words have in common."""
    start, end = F.expr("substring(word, 1, x.a)"), F.expr("right(word, x.b)")
    return rows.select("word", "n", "x.*", F.xxhash64("x.m", "x.a", "x.b", start, end).alias("key"))


def _groups(words: DataFrame, most: int) -> DataFrame:
    """word, n, m, a, b, guard, key: every word in the groups where its near words are."""
    n = F.length("word")
    lengths = words.select("word", "n", F.explode(F.array(n - 1, n)).alias("m"))
    first = lengths.select("word", "n", F.explode(_halved(F.col("word"), F.col("m"), F.lit(0), F.lit(0), F.col("m") + 2)).alias("x"))
    groups, done = cut(_keyed(first)), None
    while True:
        open_ = F.max(F.col("m") - F.col("a") - F.col("b")) > 1
        large = groups.groupBy("key").agg(F.count(F.lit(1)).alias("held"), open_.alias("open")).where((F.col("held") > most) & F.col("open"))
        large = cut(large.select("key"))
        if large.isEmpty():
            return groups if done is None else done.unionByName(groups)
        small = groups.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        again = groups.join(large, "key", "left_semi").select("word", "n", F.explode(_halved(*(F.col(c) for c in ("word", "m", "a", "b", "guard")))).alias("x"))
        groups = cut(_keyed(again))


def _codes(words: list[str], width: int, beyond: int) -> np.ndarray:
    """Code points as rows of a matrix, filled up with `beyond`."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "u4")
    sizes = np.array([len(w) for w in words])
    out = np.full((len(words), width), beyond, "i4")
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def near_in_sorted(group: np.ndarray, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) of places in a list that are in one group and one edit apart, both ways. The list is sorted by group and text.

    At depth k the list falls into ranges of one group and k common code points; a pair of a query and a range holds three cells of the
    query's matrix after k code points, D[k][k-1], D[k][k] and D[k][k+1], of which values above 1 need no telling apart."""
    sizes = np.array([len(w) for w in rests], "i8")
    if not len(sizes):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    width = int(sizes.max()) + 2
    text, asked = _codes(rests, width, -1), _codes(rests, width + 1, -2)
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    start_of = lambda new: np.flatnonzero(new)
    starts, number = start_of(fresh), np.cumsum(fresh) - 1
    ends = np.append(starts[1:], len(group))
    q, r = np.arange(len(group)), number.copy()
    zero, one, two = (np.full(len(q), x, "i1") for x in (0, 1, 2))
    below, here, above = two, zero, one
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(width - 1):
        # The first word of a range ends here if its length is k.
        first = starts[r]
        over = sizes[q] - k
        last = np.where(over == -1, below, np.where(over == 0, here, np.where(over == 1, above, 2)))
        hit = (sizes[first] == k) & (last == 1)
        out.append((q[hit], first[hit]))
        # Ranges of one more common code point; LCPs of adjacent words say where they begin.
        fresh = fresh | np.concatenate([[True], text[1:, k] != text[:-1, k]])
        next_starts, next_number = start_of(fresh), np.cumsum(fresh) - 1
        from_, to = next_number[starts[r]], next_number[ends[r] - 1] + 1
        from_ = from_ + (sizes[first] == k)  # what ended is done
        n = np.maximum(to - from_, 0)
        at = np.repeat(np.arange(len(q)), n)
        child = np.repeat(from_ - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(at))
        q, below, here, above = q[at], below[at], here[at], above[at]
        c = text[next_starts[child], k]
        other = lambda j: (asked[q, j] != c).astype("i1") if j >= 0 else np.full(len(q), 2, "i1")  # noqa: B023, E731
        low = np.minimum(below + other(k - 1), here + 1)
        mid = np.minimum(np.minimum(here + other(k), above + 1), low + 1)
        high = np.minimum(above + other(k + 1), mid + 1)
        near = np.minimum(np.minimum(low, mid), high) <= 1
        q, r = q[near], child[near]
        below, here, above = (np.minimum(x[near], 2).astype("i1") for x in (low, mid, high))
        starts, ends = next_starts, np.append(next_starts[1:], len(group))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _found(table: pa.Table) -> pa.Table:
    """word, n_near, form, form_n: for each word of some groups that has near words there, how many and the most frequent one."""
    words, key = table["word"].to_pylist(), table["key"].to_numpy()
    n, m, a, b, guard = (table[c].to_numpy() for c in ("n", "m", "a", "b", "guard"))
    rests = [w[x : len(w) - y] for w, x, y in zip(words, a, b, strict=True)]
    order = sorted(range(len(words)), key=lambda i: (key[i], rests[i]))
    rests = [rests[i] for i in order]
    order = np.array(order, "i8")
    asked, found = near_in_sorted(key[order], rests)
    sizes = np.array([len(w) for w in words], "i8")[order]
    shortest = np.minimum(sizes[asked], sizes[found]) == m[order][asked]
    asked, found = asked[shortest], found[shortest]
    # Those with a longer common start than the group's guard are found in another group.
    width = max(map(len, rests), default=0)
    text = _codes(rests, width + 1, -1)
    same = np.cumprod(text[asked] == text[found], axis=1).sum(axis=1)
    own = same + a[order][asked] < guard[order][asked]
    asked, found = asked[own], found[own]
    by_text = np.argsort(np.array([words[i] for i in order], object), kind="stable")
    rank = np.empty(len(order), "i8")
    rank[by_text] = np.arange(len(order))
    much = n[order]
    best = np.lexsort((rank[found], -much[found], asked))
    asked, found = asked[best], found[best]
    first = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]])) if len(asked) else np.zeros(0, "i8")
    many = np.diff(np.append(first, len(asked)))
    name = lambda places: pa.array([words[order[i]] for i in places], pa.string())
    return pa.table({"word": name(asked[first]), "n_near": pa.array(many, pa.int64()), "form": name(found[first]), "form_n": pa.array(much[found[first]], pa.int64())})


def near_words(words: DataFrame, most: int = GROUP, held: int = HELD) -> DataFrame:
    """word, n_near, form, form_n: words that have near ones, how many, and the most frequent of them with its count.
    `words` (word, n) has each word once."""
    groups = _groups(words, most)
    parts = max(1, -(-groups.count() // held))
    dealt = groups.withColumn("part", F.pmod("key", F.lit(parts)))
    found = dealt.groupBy("part").applyInArrow(lambda t: _found(t.drop_columns(["part"])), "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def _last(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms. Each round doubles the steps taken; forms grow in frequency, so chains are short and end."""
    forms = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut(forms.join(further, "root", "left").select("word", "root", "next"))
        if joined.where("next IS NOT NULL").isEmpty():
            return joined.select("word", "root")
        forms = joined.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root: a row for each word that occurs LEAST times or more. The form is the most frequent near
    word, if it occurs TIMES as often; the root is the last of the forms that follow from a word, the word itself if it has none."""
    words = cut(vocabulary(docs, id_col, text_col).where(F.col("n") >= LEAST))
    near = near_words(words)
    often = F.col("form_n") >= TIMES * F.col("n")
    joined = words.join(near, "word", "left").withColumns({"form": F.when(often, F.col("form")), "form_n": F.when(often, F.col("form_n"))})
    rows = cut(joined.withColumn("n_near", F.coalesce("n_near", F.lit(0))))
    discard(words)
    roots = _last(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
