"""Document fingerprints by spot signatures.

Where a common word (an anchor) occurs, the next CHAIN words that are no anchors form, with it, one spot
signature. The set of a text's signatures is its fingerprint. Texts without anchors, or too short for a chain,
fall back to what they have: incomplete chains at the end count, and a text without any signature has its
words as one signature, so different texts differ and equal texts are equal.

Two fingerprints are compared by Jaccard likeness. To find similar documents, fingerprints are dealt into
partitions by size: sets whose sizes differ by more than the threshold cannot be alike, so a document meets
only its own partition and the next. Within these, documents meet through their rarest signatures (a prefix
long enough that similar sets must share one), and a comparison stops as soon as the bound on what is left
rules the threshold out.

Cases: null texts are empty; an empty text has an empty fingerprint, which is like another empty one (1) and
unlike any other (0). Texts are read whole. Equal texts have equal fingerprints. Repeated rows are kept: each
is followed by the next row in order of id, then text. An empty table gives an empty one; the next document
of a single document is itself. Of the input only id and text are used.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import text_or_empty

CHAIN, LIKENESS = 3, 0.8
WORD = re.compile(r"[^\W_]+")
# Common words of four languages, the anchors.
ANCHORS = frozenset(
    "a an and are as at be by for from has have he in is it its of on or that the this to was were will with "
    "aber als am auch auf aus bei das dem den der des die ein eine einer es für im in ist mit nicht noch nur oder sich sie sind und von war werden wie wird zu zum "
    "au aux avec ce cette dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une vous "
    "al como con de del el en es está la las lo los más no o para pero por que se ser si sin su sus un una y ya".split()
)


def signatures(text: str | None) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's spot signatures."""
    words = WORD.findall((text or "").lower())
    content = [k for k, w in enumerate(words) if w not in ANCHORS]
    spots, after = set(), 0  # after: index in `content` of the first content word behind the anchor
    for k, w in enumerate(words):
        if w in ANCHORS:
            while after < len(content) and content[after] < k:
                after += 1
            chain = content[after : after + CHAIN]
            if chain:
                spots.add(" ".join([w, *[words[j] for j in chain]]))
    if not spots and text:
        spots = {" ".join(words) if words else text}
    digest = hashlib.blake2b
    return np.unique(np.array([int.from_bytes(digest(s.encode(), digest_size=8).digest(), "little") for s in spots], "u8"))


def fingerprint(sigs: np.ndarray) -> str:
    """The signatures as hexadecimal digits, 16 each, in order."""
    return sigs.astype(">u8").tobytes().hex()


def parsed(fp: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fp), ">u8").astype("u8")


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 as soon as it can be told that it is below `least`."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    shared, step = 0, 512
    # Both sets in step through ranges of hash values; what is left bounds what can still be shared.
    i = j = 0
    while i < len(a) and j < len(b):
        if least:
            most = shared + min(len(a) - i, len(b) - j)
            if most < least * (len(a) + len(b) - most):
                return 0.0
        top = min(a[min(i + step, len(a)) - 1], b[min(j + step, len(b)) - 1])
        i2, j2 = (int(np.searchsorted(x, top, "right")) for x in (a, b))
        shared += len(np.intersect1d(a[i:i2], b[j:j2], assume_unique=True))
        i, j = i2, j2
    likeness = shared / (len(a) + len(b) - shared)
    return likeness if likeness >= least else 0.0


# Following documents ------------------------------------------------------------------------------------

ROWS_A_RANGE, MOST_RANGES = 2000, 20_000


def _ranges(docs: DataFrame, id_col: str) -> list:
    """Ids that split the table into ranges of about ROWS_A_RANGE rows; a bounded number, as many as there are tasks
    of a range sort."""
    ids = docs.select(id_col).where(F.col(id_col).isNotNull())
    n = ids.count()
    parts = max(1, min(MOST_RANGES, n // ROWS_A_RANGE))
    cuts = ids.stat.approxQuantile(id_col, [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted({int(x) for x in cuts})


def _cuts_upto(value, cuts: list[int]):
    """How many of the sorted cuts are not above a value: found in two steps, by block and within it."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    blocks = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    many = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    block = F.size(F.filter(many([b[0] for b in blocks]), lambda c: c <= value))
    within = F.size(F.filter(F.element_at(F.array(*map(many, blocks)), block), lambda c: c <= value))
    return F.when(block == 0, 0).otherwise((block - 1) * width + within)


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (the last half of its code points replaced by as many first
    ones of the next document's text), and their likeness.

    The table is dealt once into ranges of ids. The first document of each range is dealt a second time, to the
    range before, where it ends the row of documents; so the next document is always at hand and no window spans
    the table. Only texts of one Arrow batch and one more are held."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    cuts = _ranges(rows, "doc_id")
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(_cuts_upto(F.col("doc_id"), cuts)))
    # A range's first document: by id, then by text.
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "text")).alias("f"))
    parts = sorted(r.part for r in first.select("part").collect())
    before = {p: parts[k - 1] for k, p in enumerate(parts)}  # the first range's document ends the last range
    pairs = docs.sparkSession.createDataFrame([(p, q) for p, q in before.items()] or [(-1, -1)], "part int, to int")
    ends = first.join(pairs, "part").select(F.col("f.doc_id").alias("doc_id"), F.col("f.text").alias("text"), F.col("to").alias("part"), F.lit(True).alias("ends"))
    both = rows.withColumn("ends", F.lit(False)).select("doc_id", "text", "part", "ends").unionByName(ends)
    n = max(1, min(len(parts), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4))
    dealt = both.repartition(n, "part").sortWithinPartitions("part", "ends", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_edit, EDITED)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None  # the row before: part, id, text, signatures
    for batch in batches:
        out: list[tuple] = []
        for part, ends, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ends", "doc_id", "text")), strict=True):
            sigs = signatures(text)
            if before and before[0] == part:
                _, own_id, own, own_sigs = before
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                edited_sigs = signatures(edited)
                out.append(
                    (
                        own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own_sigs), fingerprint(edited_sigs),
                        jaccard(own_sigs, edited_sigs), jaccard(own_sigs, sigs),
                    )
                )
            before = None if ends else (part, doc_id, text, sigs)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


# Similar documents --------------------------------------------------------------------------------------


def _size_part(n: int, least: float) -> int:
    return int(math.log(max(n, 1)) / -math.log(least))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sigs array<long>: a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [signatures(t).view("i8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.list_(pa.int64()))], names=["id", "sigs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], text_or_empty(docs[text_col])).mapInArrow(run, f"id {kind}, sigs array<long>")


def similar_pairs(docs: DataFrame, least: float = LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, likeness of documents with different fingerprints that are at least `least` alike; a < b. Documents
    with equal fingerprints are represented by the least id (see `classes_of_equals`). Candidates share a
    (size partition, rare signature) key of their prefixes; none is left out."""
    prints = classes_of_equals(docs, id_col, text_col).groupBy("class_id").agg(F.first("sigs").alias("sigs")).where(F.size("sigs") > 0)
    exploded = prints.select("class_id", F.explode("sigs").alias("sig"))
    counts = exploded.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("class_id").orderBy("df", "sig")
    ranked = exploded.join(counts, "sig").withColumn("rank", F.row_number().over(order))
    sizes = prints.select("class_id", F.size("sigs").alias("n"))
    prefix = (
        ranked.join(sizes, "class_id")
        .where(F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
        .withColumn("part", F.floor(F.log(F.col("n").cast("double")) / -math.log(least)))
    )
    probe = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    build = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    alike = F.col("na") >= least * F.col("nb")
    pairs = probe.join(build, ["sig", "part"]).where(smaller & alike).select("a", "b").distinct()
    left, right = (prints.select(F.col("class_id").alias(c), F.col("sigs").alias(f"sigs_{c}")) for c in ("a", "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.array(x, "i8").view("u8") for x in batch.column(k).to_pylist()] for k in (2, 3)]
            likeness = pa.array([jaccard(np.sort(x), np.sort(y), least) for x, y in zip(*sets, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), likeness], names=["a", "b", "likeness"])

    kind = docs.schema[id_col].dataType.simpleString()
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "sigs_a", "sigs_b")
    found = met.mapInArrow(compare, f"a {kind}, b {kind}, likeness double").where(F.col("likeness") >= least)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def classes_of_equals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sigs, class_id: the least id among the documents with the same fingerprint."""
    prints = fingerprints(docs, id_col, text_col).withColumn("key", F.xxhash64("sigs"))
    least = prints.groupBy("key").agg(F.min("id").alias("class_id"))
    return prints.join(least, "key").select("id", "sigs", "class_id")
