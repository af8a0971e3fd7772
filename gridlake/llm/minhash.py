"""Near-duplicates by order MinHash and banded alignment.

A text is its sequence of words; its k-mers are runs of five words, labelled by occurrence so that a repeated
one counts each time. Each of HASHES functions orders the labelled k-mers; the `length` smallest of them, kept
in the order in which they stand in the text, form one key. Two texts share a key the likelier, the more
k-mers they share in the same order, so keys follow edit similarity and not just common content. Texts with a
common key are candidates; the words of candidates are aligned within the band that the threshold allows, and
those at least `least` alike (1 - word edits / words of the longer text) are linked. Classes are the
components of the links; the class id is the least document id.

Copies (equal word sequences) are one node and take part once. In each bucket of a key only the
node of the least id, its leader, is compared with the others, so a bucket of any size gives no more pairs than it
has members, and where most pairs are true, as among near copies, the leader joins them all. What is not alike to the leader is
compared with one more of each bucket, which is in one component with the leader. Buckets that still
hold members of different components are finished exactly: all pairs of one such bucket, leaders and linked ones too, are
compared, but for pairs that are in one component and pairs that cannot be alike. Those alike have
all but `most` of the longer text's words in common, so they share one of their most + 1 rarest words (a repeated
one told apart by its number; rare among these members), and their lengths differ by at most `most`. A passage that
many texts share is not among the rarest words of a text unless nearly all of it is that passage. Texts of LONG words or more
have so many rare words that nearly any two share some, but few keys that they share with texts they are not alike to; they
meet in their buckets, with shorter ones too, and not by words. What meets is told apart by bits of its words, then by larger
sketches; of pairs that met by words only those of a common bucket stay; what is left is aligned. No bucket is capped or dropped.

A link is a pair of texts that are alike and share a key, whatever their lengths are and whatever else the table holds; how a
pair meets is a matter of cost. So classes are the components of these links, and any two texts alike that share a key are in one.

Texts under SHORT words have each single k-mer as a further key, so any two of them with a common k-mer meet.

What is found: of texts under SHORT words all that have a common k-mer; of longer ones those of at least two common
k-mers: two texts that share a fifth of their k-mers (about the threshold, with edits spread evenly) meet with
probability 0.96, those that share a third with more than 0.999. A text under SHORT words and a longer one meet as
two longer ones do. Texts under five words are compared as wholes, so only copies of them are found.

Hot keys: a bucket, class or copied text with more than a two-thousandth of all rows gets its leader or label from a local
table and stays spread over all tasks; the others are joined by shuffles, of which Spark splits skewed partitions.

Cases: texts without words are copies of each other. A null text is like no other; rows with a null text and
one id, or none, are repeated rows. Repeated rows are copies. Different texts with one id, or without ids, stay different:
the class id is the least id of a class, null if it has none, and `one_of_each` keeps a row of each class whatever the
ids are. Texts are read whole. An empty table gives an empty one. Of the input only id and text are used, but
`one_of_each` returns all columns, under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from gridlake.llm.common import HOT, cut, discard, with_looked_up, word_array

K, LEAST = 5, 0.8
#: Hash functions; how many of them the first round of comparisons uses.
HASHES, FIRST = 80, 6
#: k-mers of a key.
LENGTH = 2
#: Texts of fewer words have their single k-mers as keys too. Texts alike of which the shorter has up to 31 words
#: both have, at the threshold of LEAST.
SHORT = 40
#: Texts of this many words or more meet by their buckets in the exact search, shorter ones by their rare words, of which pairs
#: without a common bucket are dropped. Chosen by cost only: either way the pairs alike of a common bucket are found.
LONG = 400
#: Cells in which words, and keys, are counted to tell rare from common ones; the table of counts is what reaches the driver.
CELLS_HELD = 1 << 17
#: Longs that hold the bits of a text's words.
BITS = 8
#: Hash values that are held at once for a long text.
CELLS = 1 << 21


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, 2 * HASHES + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = _SEEDS[:HASHES, None], _SEEDS[HASHES:, None] | np.uint64(1)


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers, those after a first occurrence told apart by their number."""
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, "u8")
    for j in range(k):
        h = _mixed(h + np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(h)].view("u8"))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if same.any():
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        number = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
        label = np.empty(len(h), "u8")
        label[order] = number.astype("u8")
        h = np.where(label > 0, _mixed(h + label * np.uint64(0xD6E8FEB86659FD93)), h)
    return h


def keys(words: np.ndarray, length: int) -> np.ndarray:
    """One key for each hash function: its smallest k-mers in text order; then, if the text is short, one for each
    k-mer. Empty for texts without words."""
    if not len(words):
        return np.zeros(0, "i8")
    h = labelled_kmers(words)
    n, block = min(length, len(h)), max(1, CELLS // len(h))
    out = np.empty(HASHES, "u8")
    for at in range(0, HASHES, block):
        v = (h ^ _XOR[at : at + block]) * _ODD[at : at + block]
        v ^= v >> np.uint64(32)
        rows = np.arange(len(v))
        places = np.empty((len(v), n), "i8")
        if n <= 2:
            for c in range(n):
                places[:, c] = v.argmin(axis=1)
                v[rows, places[:, c]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        else:
            places = np.argpartition(v, n - 1, axis=1)[:, :n] if n < len(h) else np.tile(np.arange(n), (len(v), 1))
        places.sort(axis=1)
        key = np.arange(at, at + len(v), dtype="u8") * np.uint64(1000003) + np.uint64(n)
        for c in range(n):
            key = _mixed(key + h[places[:, c]])
        out[at : at + block] = key
    if K <= len(words) < SHORT:
        out = np.concatenate([out, _mixed(h ^ np.uint64(0xA0761D6478BD642F))])
    return out.view("i8")


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Edits between two word lists if at most `most`, else most + 1.

    Columns of the table of distances are held as bits: whether a row is one more or one less than the row
    above it. Only a band of rows around the diagonal is held, which moves down by one with each column; what
    lies outside can only cost more than `most`. Bits of rows above the table count away from its top row."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    width = 2 * most + 1
    mask, top, slack = (1 << width) - 1, 1 << (width - 1), most + len(a) - len(b)
    up, down = mask >> (most + 1) << (most + 1), (1 << (most + 1)) - 1
    distance = 0
    for j, w in enumerate(b, 1):
        match, first = places.get(w, 0), j - most - 1
        match = (match >> first if first >= 0 else match << -first) & mask
        up, down = up >> 1 | top, down >> 1
        same = (((match & up) + up) ^ up) | match | down
        right_up = (down | ~(same | up)) & mask
        right_down = same & up
        right_up = (right_up << 1 | 1) & mask
        right_down = right_down << 1 & mask
        up, down = (right_down | ~(same | right_up)) & mask, same & right_up & mask
        if not same >> most & 1:
            distance += 1
            if distance > slack:
                return most + 1
    below = ((1 << (len(a) - len(b))) - 1) << (most + 1)
    distance += (up & below).bit_count() - (down & below).bit_count()
    return distance if distance <= most else most + 1


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    n = max(len(a), len(b))
    most = int((1 - least) * n + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # Words that the other text does not have cost an edit each; this settles most that merely share a passage.
    (wa, ca), (wb, cb) = (np.unique(x, return_counts=True) for x in (a, b))
    _, ia, ib = np.intersect1d(wa, wb, assume_unique=True, return_indices=True)
    if n - np.minimum(ca[ia], cb[ib]).sum() > most:
        return False
    return edit_distance(a.tolist(), b.tolist(), most) <= most


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Arrow lists as numpy arrays, without a copy."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _words(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id, node (hash of the word sequence; of the id where the text is null), check (a second one), `more`, words (64-bit hashes)."""
    words = F.transform(word_array(docs[text_col]), lambda w: F.xxhash64(w)).alias("words")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].isNull().alias("none"), words, *more)
    own = lambda seed: F.when(F.col("none"), F.xxhash64("id", F.lit("null"), F.lit(seed))).otherwise(F.xxhash64("words", F.lit(seed)))
    return rows.select("id", own(0).alias("node"), own(1).alias("check"), *rows.columns[3:], "words")


def _hashable(docs: DataFrame) -> list[Column]:
    return [docs[f.name] for f in docs.schema if not isinstance(f.dataType, MapType)]


def _row_hashes(columns: list[Column]) -> list[Column]:
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")]


def _with_keys(rows: DataFrame, length: int, extra: str) -> DataFrame:
    """`extra` columns and keys array<long>, from rows whose last column is words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, words = batch.columns
            found = [keys(w.astype("i8", copy=False), length) for w in _lists(words)]
            yield pa.RecordBatch.from_arrays([*others, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "keys"])

    return rows.mapInArrow(run, f"{extra}, keys array<long>")


def _second(met: DataFrame, comp: DataFrame) -> DataFrame:
    """leader, rep: members apart from their bucket's leader, with another member that is in one component with it. Which one
    differs from bucket to bucket, so a near copy that is too far from the leader meets several that may lie between."""
    mine, other = (comp.select(F.col("rep").alias(c), F.col("comp").alias(f"comp_{c}")) for c in ("rep", "leader"))
    joined = cut(met.join(mine, "rep", "left").join(other, "leader", "left").select("bucket", "rep", (F.coalesce("comp_rep", "rep") == F.coalesce("comp_leader", "leader")).alias("linked")))
    inside = joined.where("linked").groupBy("bucket").agg(F.min_by("rep", F.xxhash64("rep", "bucket")).alias("second"))
    return joined.where("NOT linked").join(inside, "bucket").select(F.least("second", "rep").alias("leader"), F.greatest("second", "rep").alias("rep"))


def _sum_cells(lists: DataFrame, cells_of) -> np.ndarray:
    """How many entries of a list column fall into each of CELLS_HELD cells; each task counts its own, and only counts travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS_HELD, "i8")
        for batch in batches:
            for part in cells_of(batch.column(0)):
                held += np.bincount(part.view("i8"), minlength=CELLS_HELD)
        cell = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(held[cell], pa.int64())], names=["cell", "n"])

    counts = lists.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(CELLS_HELD, "i8")
    held[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    return held


def _key_cells(column: pa.Array) -> Iterator[np.ndarray]:
    yield column.flatten().to_numpy(zero_copy_only=False).view("u8") % np.uint64(CELLS_HELD)


def _buckets(keyed: DataFrame, total: int) -> DataFrame:
    """bucket, rep, leader, function: the members of each key but the one with the least id (`first`), which leads: it is likelier
    than others to be what near copies were made from, and so to be alike to all of them. Leaders of buckets that may be hot
    (their cell of hash values holds many members) are found by aggregation, the others' by a window over the bucket."""
    rows = keyed.select(F.col("node").alias("rep"), "first", F.posexplode("keys").alias("function", "bucket"))
    held = _sum_cells(keyed.select("keys"), _key_cells)
    hot_cells = np.flatnonzero(held > max(1000, held.mean() + total * HOT)).tolist()
    hot = F.pmod(F.col("bucket").bitwiseAND(F.lit(CELLS_HELD - 1)), F.lit(CELLS_HELD)).isin(hot_cells) if hot_cells else F.lit(False)
    order = Window.partitionBy("bucket").orderBy(F.col("first").asc_nulls_last(), "rep").rowsBetween(Window.unboundedPreceding, 0)
    led = rows.where(~hot).withColumn("leader", F.first("rep").over(order)).where("leader <> rep").drop("first")
    if not hot_cells:
        return led
    common = cut(rows.where(hot))
    rank = F.struct(F.col("first").isNull().alias("unnamed"), "first", "rep")
    leaders = cut(common.groupBy("bucket").agg(F.min(rank)["rep"].alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return led.unionByName(with_looked_up(common.drop("first"), leaders, "bucket", "n", total).where("leader <> rep"))


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """leader, rep of the pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_lists(batch.column(c)) for c in ("words_a", "words_b"))
            good = pa.array([alike(x, y, least) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["leader", "rep"]).filter(good)

    left, right = (words.select(F.col("node").alias(c), F.col("words").alias(w)) for c, w in (("leader", "words_a"), ("rep", "words_b")))
    met = pairs.join(left, "leader").join(right, "rep").select("leader", "rep", "words_a", "words_b")
    return met.mapInArrow(run, "leader long, rep long")


def components(links: DataFrame) -> DataFrame:
    """rep, comp: the least member of each linked one's component. `links` has leader < rep.

    Each round hangs the neighbours of every node to the least one among them and itself, first the greater
    neighbours, then the smaller ones; stars are reached in a number of rounds that grows with the logarithm of
    the longest chain. Nothing but whether this is so comes to the driver."""
    edges = cut(links.select(F.col("rep").alias("u"), F.col("leader").alias("v")).distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
    return edges.select(F.col("u").alias("rep"), F.col("v").alias("comp"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs to one other, which hangs to none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    nodes = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty()


def _apart(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The rows whose leader and member are not in one component yet."""
    if comp is None:
        return rows
    mine, other = (comp.select(F.col("rep").alias(c), F.col("comp").alias(f"comp_{c}")) for c in ("rep", "leader"))
    joined = rows.join(mine, "rep", "left").join(other, "leader", "left")
    apart = F.coalesce("comp_rep", "rep") != F.coalesce("comp_leader", "leader")
    return joined.where(apart).drop("comp_rep", "comp_leader")


def _word_cells(column: pa.Array) -> Iterator[np.ndarray]:
    for w in _lists(column):
        if len(w):
            yield labelled_kmers(w.astype("i8"), 1) % np.uint64(CELLS_HELD)


def _with_rare(texts: DataFrame, held: np.ndarray, least: float) -> DataFrame:
    """rep, size, bits, tokens: the most + 1 rarest words of each text under LONG words, those after a first occurrence told apart by
    their number, where `most` are the edits that the text allows; `bits` has one bit set for each word, by its hash.
    Rare is by `held`, the same for all, so that texts alike share one of these words whatever the counts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, words = batch.columns
            sizes, tokens, all_bits = [], [], []
            for w in _lists(words):
                t = labelled_kmers(w.astype("i8"), 1)
                bits = np.zeros(64 * BITS, "u1")
                bits[t % np.uint64(64 * BITS)] = 1
                sizes.append(len(w))
                all_bits.append(np.packbits(bits).view("i8"))
                if len(w) < LONG:
                    order = np.lexsort((t, held[t % np.uint64(CELLS_HELD)]))
                    t = t[order[: int((1 - least) * len(w) + 1e-9) + 1]]
                tokens.append(t.view("i8") if len(w) < LONG else None)
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (all_bits, tokens))
            yield pa.RecordBatch.from_arrays([rep, pa.array(sizes, pa.int64()), *lists], names=["rep", "size", "bits", "tokens"])

    return texts.select(F.col("node").alias("rep"), "words").mapInArrow(run, "rep long, size long, bits array<long>, tokens array<long>")


def _possible(texts: DataFrame, buckets: DataFrame, comp: DataFrame | None, least: float) -> DataFrame:
    """leader, rep of all pairs of the texts that can be alike, are not in one component and are in a common bucket of `buckets`
    (bucket, rep); of pairs under LONG words those without a common bucket too, which `_in_one_bucket` drops.

    A token is a rare word or a bucket. Texts meet by tokens first as groups, the members of one component that have the token, those of the smaller
    component first, so a large component makes no pairs with itself. Words that one text has and the other lacks are counted
    from below by the bits: of groups, by the bits that all members of one have and no member of the other. Most groups are
    single texts and settled as they meet; only those of several go back to their members."""
    texts = cut(texts)
    about = _with_rare(texts, _sum_cells(texts.select("words"), _word_cells), least)
    about = about.withColumn("comp", F.col("rep")) if comp is None else about.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    about = cut(about)
    # What may be alike to a text of LONG words or more.
    shortest = LONG - int((1 - least) * LONG + 1e-9)
    in_buckets = cut(buckets.join(about.where(F.col("size") >= shortest).select("rep", "comp"), "rep").select(F.col("bucket").alias("token"), "comp", "rep"))
    members = about.select(F.explode("tokens").alias("token"), "comp", "rep").unionByName(in_buckets)
    shared = members.select("token", "comp").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("comps")).where("comps > 1")
    sharing = cut(members.join(shared.select("token"), "token", "left_semi"))
    members = sharing.join(about.select("rep", "size", "bits"), "rep")
    several = F.count(F.lit(1)) > 1
    each = lambda f: F.array(*[f(F.col("bits")[k]) for k in range(BITS)])
    groups = cut(
        members.groupBy("token", "comp").agg(
            F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep"), F.min("size").alias("lo"), F.max("size").alias("hi"),
            each(F.bit_and).alias("has"), F.when(several, each(F.bit_or)).alias("may"),
        )
    )
    one, two = (groups.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("comp", "n", "rep", "lo", "hi", "has", "may")]) for x in "ab")
    first = F.struct("n_a", "comp_a") < F.struct("n_b", "comp_b")
    longer = F.greatest("lo_a", "lo_b")
    common = longer - _most(longer, least)
    near = _near(common, "hi_a", "hi_b", "has_a", "has_b", F.coalesce("may_a", "has_a"), F.coalesce("may_b", "has_b"))
    met = cut(one.join(two, "token").where(first & near).select("token", "comp_a", "comp_b", "rep_a", "rep_b", "n_a", "n_b"))
    singles = met.where("n_a = 1 AND n_b = 1").select("rep_a", "rep_b")
    whole = cut(members.join(groups.where("n > 1").select("token").distinct(), "token", "left_semi"))
    a, b = (whole.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("comp", "rep", "size", "bits"))) for x in "ab")
    longer = F.greatest("size_a", "size_b")
    near = _near(longer - _most(longer, least), "size_a", "size_b", "bits_a", "bits_b", F.col("bits_a"), F.col("bits_b"))
    many = met.where("n_a > 1 OR n_b > 1").select("token", "comp_a", "comp_b")
    many = many.join(a, ["token", "comp_a"]).join(b, ["token", "comp_b"]).where(near).select("rep_a", "rep_b")
    pairs = cut(singles.unionByName(many).select(F.least("rep_a", "rep_b").alias("leader"), F.greatest("rep_a", "rep_b").alias("rep")).distinct())
    discard(about, in_buckets, sharing, groups, met, whole)
    return _alike_by_sketch(pairs, texts, least)


def _in_one_bucket(pairs: DataFrame, buckets: DataFrame) -> DataFrame:
    """The pairs that share a bucket, each once. Those of long texts do; those that met by words may not."""
    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("leader", "rep")).alias("rep")).distinct()
    own = cut(buckets.join(ids, "rep", "left_semi"))
    of_leader = pairs.join(own.withColumnRenamed("rep", "leader"), "leader")
    return of_leader.join(own, ["rep", "bucket"], "left_semi").select("leader", "rep").distinct()


def _alike_by_sketch(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs that can be alike by sketches of their texts: bits as in `_with_rare`, but a number of them that grows with the
    text, so that those of long texts are not all set. Sketches are far smaller than texts, which only what is left needs."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, words = batch.columns
            lists = _lists(words)
            out = []
            for w in lists:
                bits = np.zeros(max(512, 1 << (3 * max(1, len(w)) - 1).bit_length()), "u1")
                bits[labelled_kmers(w.astype("i8"), 1) & np.uint64(len(bits) - 1)] = 1
                out.append(np.packbits(bits, bitorder="little").view("i8"))
            yield pa.RecordBatch.from_arrays([node, pa.array([len(w) for w in lists], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["node", "size", "bits"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("size_a").to_pylist(), batch.column("size_b").to_pylist(), strict=True)
            bits = zip(_lists(batch.column("bits_a")), _lists(batch.column("bits_b")), strict=True)
            good = [_can_be_alike(n, m, a, b, least) for (n, m), (a, b) in zip(sizes, bits, strict=True)]
            yield batch.select(["leader", "rep"]).filter(pa.array(good, pa.bool_()))

    sketches = texts.where(F.size("words") > 0).select("node", "words").mapInArrow(sketch, "node long, size long, bits array<long>")
    left, right = (sketches.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{y}") for x in ("size", "bits"))) for c, y in (("leader", "a"), ("rep", "b")))
    met = pairs.join(left, "leader").join(right, "rep").select("leader", "rep", "size_a", "size_b", "bits_a", "bits_b")
    return met.mapInArrow(keep, "leader long, rep long")


def _can_be_alike(n: int, m: int, a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether texts of n and m words may be alike: each word whose bit the other lacks costs an edit."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    longer = max(n, m)
    common = longer - int((1 - least) * longer + 1e-9)
    lacks_a, lacks_b = (int(np.bitwise_count((x & ~y).view("u8")).sum()) for x, y in ((a, b), (b, a)))
    return n - lacks_a >= common and m - lacks_b >= common


def _near(common: Column, size_a: str, size_b: str, has_a: str, has_b: str, may_a: Column, may_b: Column) -> Column:
    """Whether both sides may have `common` words in common: neither is shorter, nor lacks too many that the other has."""
    lacks = lambda x, y: reduce(Column.__add__, (F.bit_count(F.col(x)[k].bitwiseAND(F.bitwise_not(y[k]))) for k in range(BITS)))
    return (F.least(size_a, size_b) >= common) & (F.col(size_a) - lacks(has_a, may_b) >= common) & (F.col(size_b) - lacks(has_b, may_a) >= common)


def _most(size: Column, least: float) -> Column:
    """Edits that `alike` allows for a longer text of that many words."""
    return F.floor((1 - least) * size + 1e-9)


def _classed(docs: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """id, group (what tells classes apart), class_id, h1, h2: a row for each row of the input."""
    kind = docs.schema[id_col].dataType.simpleString()
    words = _words(docs, id_col, text_col)
    hashed = _words(docs, id_col, text_col, *_row_hashes(_hashable(docs)))
    keyed = cut(_with_keys(hashed, LENGTH, f"id {kind}, node long, check long, h1 long, h2 long"))
    rows = cut(keyed.drop("keys"))
    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.min("check").alias("least_check"), F.count(F.lit(1)).alias("n"))
    nodes = cut(nodes)
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Rows of one node have the same words and so the same keys, but for hashes that collide; of these one counts.
    one = cut(keyed.groupBy("node").agg(F.min("keys").alias("keys"), F.min("id").alias("first")))
    discard(keyed)
    met = cut(_buckets(one, total))
    discard(one)
    ids = met.select(F.explode(F.array("rep", "leader")).alias("node")).distinct()
    short = words.select("node", F.transform("words", lambda w: w.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("words"))
    cand = cut(short.join(ids, "node", "left_semi").dropDuplicates(["node"]))

    links: list[DataFrame] = []
    tested: list[DataFrame] = []
    comp: DataFrame | None = None

    def compare(pairs: DataFrame) -> None:
        """Compares leaders and members of the pairs that have not been compared, and links what is alike."""
        nonlocal comp
        pairs = pairs.select("leader", "rep").distinct()
        for done in tested:
            pairs = pairs.join(done, ["leader", "rep"], "left_anti")
        pairs = cut(pairs)
        if pairs.isEmpty():
            return
        tested.append(pairs)
        links.append(cut(_verified(pairs, cand, least)))
        if not links[-1].isEmpty():
            comp = components(reduce(DataFrame.unionByName, links))

    compare(met.where(F.col("function") < FIRST))
    compare(_apart(met, comp))
    if comp is not None:
        compare(_second(met, comp))
    open_ = met.join(cut(_apart(met, comp).select("bucket").distinct()), "bucket", "left_semi")
    ids = cut(open_.select(F.explode(F.array("leader", "rep")).alias("node")).distinct())
    if not ids.isEmpty():
        in_open = open_.select("bucket", "rep").unionByName(open_.select("bucket", F.col("leader").alias("rep")).distinct())
        in_open = cut(in_open)
        compare(_in_one_bucket(_possible(cand.join(ids, "node", "left_semi"), in_open, comp, least), in_open))
    if comp is not None:
        linked = nodes.join(comp.withColumnRenamed("rep", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        linked = cut(linked.withColumnRenamed("id", "least_id"))
        labels = cut(linked.groupBy("comp").agg(F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("nodes")))
        nodes = cut(with_looked_up(linked, labels, "comp", "nodes", total).drop("least_id"))
    else:
        nodes = nodes.withColumn("comp", F.col("node")).withColumnRenamed("id", "class_id")
    found = with_looked_up(rows, nodes, "node", "n", total)
    # Hashes of 64 bits collide in very large tables: what the second one tells apart is in no class of others.
    alone = F.col("check") != F.col("least_check")
    group = F.when(alone, F.xxhash64("node", "check")).otherwise(F.col("comp"))
    return found.select("id", group.alias("group"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "h1", "h2")


def classes(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id: a row for each row of the input."""
    return _classed(docs, least, id_col, text_col).select(F.col("id").alias(id_col), "class_id")


def one_of_each(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each class, by id (rows without one last). Repeated rows are kept once."""
    rank = F.struct(F.col("id").isNull().alias("unnamed"), "id", "h1", "h2")
    first = _classed(docs, least, id_col, text_col).groupBy("group").agg(F.min(rank).alias("x")).select("x.h1", "x.h2")
    rows = docs.select(F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("box"), *_row_hashes(_hashable(docs)))
    kept = rows.join(cut(first), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return kept.select(*[F.col(f"box.c{k}").alias(c) for k, c in enumerate(docs.columns)])
