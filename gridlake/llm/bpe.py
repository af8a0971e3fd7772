"""BPE encoding and decoding with forced boundaries.

A merge can only join two symbols that stand side by side inside some vocabulary token. So wherever a
pair of neighbouring bytes occurs in no token, every encoding has a boundary. The encoder cuts words at
such pairs, merges each fragment on its own and concatenates the ids. A long fragment is merged with a heap of pairs and linked
neighbours, so a text that is one long word costs little more than its length. A worker remembers what it has encoded.

Cases: null and empty texts encode to no ids and decode to ''. Texts are encoded whole, whatever their
length. Repeated rows give repeated results; an empty table gives an empty one. Columns of the input
that are not asked for are left out, so clashing names cannot arise.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

END = "</w>"
#: White space as Unicode defines it (the White_Space property); fixed values.
SPACE = "\t-\r \x85\xa0  -     　"
#: What str.split() takes for white space though Unicode does not; fixed values.
ODD_SPACE = frozenset("\x1c\x1d\x1e\x1f")
SPACE_RUN = regex.compile(f"[{SPACE}]+")
#: Above any rank and id in one number.
NO_MERGE = 1 << 60
#: Marks, in a pair of bytes, that the second ends its word.
END_PAIR = 1 << 16
#: Fragments of more symbols are merged with a heap.
LONG = 100
#: Pieces, and words, that a worker remembers before it starts afresh (under 400 bytes each).
REMEMBERED = 300_000
#: Words of up to so many bytes are merged whole, for looking where they may be cut costs more than it saves.
UNCUT = 24


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of byte-level BPE: printable
    Latin-1 bytes stand for themselves, the others take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


class WordBpe:
    """Encoder and decoder for a vocabulary file with word ends and lower case."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*ids.items(), *self.special.items()]}
        letters = byte_letters()
        self.byte_ids = [ids[x] for x in letters]
        self.end_ids = [ids[x + END] for x in letters]
        self.merges: dict[int, int] = {}  # two ids in one number: the merge's rank and the id it gives, in one number
        for rank, m in enumerate(spec["model"]["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.merges[ids[x] << 20 | ids[y]] = rank << 20 | ids[x + y]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        byte_of = {x: b for b, x in enumerate(letters)}
        self.inside = set()  # neighbours inside some token: two bytes in one number, END_PAIR added at a word's end
        for token in ids:
            ends = token.endswith(END) and token != END
            s = [byte_of[x] for x in (token[: -len(END)] if ends else token)]
            pairs = [x << 8 | y for x, y in zip(s, s[1:], strict=False)]
            if ends and pairs:
                pairs[-1] |= END_PAIR
            self.inside.update(pairs)
        self.known = Known(self.encode_piece)
        # Most new pieces are known words beside signs, so words are remembered too.
        self.known_words = Known(self.encode_word)

    def cuts(self, word: bytes) -> list[int]:
        """Where the word's fragments start: 0, and between neighbours that stand side by side in no token."""
        pairs = [x << 8 | y for x, y in zip(word, word[1:], strict=False)]
        if pairs:
            pairs[-1] |= END_PAIR
        return [0, *(k for k, p in enumerate(pairs, 1) if p not in self.inside)]

    def merge(self, s: list[int]) -> list[int]:
        """Join the pair of lowest rank, the leftmost of these, until no pair has a rank. Changes `s`."""
        if len(s) > LONG:
            return self.merge_long(s)
        rank_of = self.merges.get
        found = [rank_of(x << 20 | y, NO_MERGE) for x, y in zip(s, s[1:], strict=False)]
        while found:
            best = min(found)
            if best == NO_MERGE:
                break
            k = found.index(best)
            s[k] = new = best & 0xFFFFF
            del s[k + 1], found[k]
            if k:
                found[k - 1] = rank_of(s[k - 1] << 20 | new, NO_MERGE)
            if k < len(found):
                found[k] = rank_of(new << 20 | s[k + 1], NO_MERGE)
        return s

    def merge_long(self, s: list[int]) -> list[int]:
        """The same with a heap of (merge, place of its left symbol) and each symbol's neighbours. A pair that has changed
        since it was put on the heap is known by its merge, which is no longer that of the symbols in its place."""
        rank_of, n = self.merges.get, len(s)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, k) for k in range(n - 1) if (m := rank_of(s[k] << 20 | s[k + 1]))]
        heapq.heapify(heap)
        while heap:
            m, k = heapq.heappop(heap)
            j = right[k]
            if s[k] < 0 or j >= n or rank_of(s[k] << 20 | s[j]) != m:
                continue
            s[k], s[j] = m & 0xFFFFF, -1
            right[k] = after = right[j]
            if after < n:
                left[after] = k
                if m := rank_of(s[k] << 20 | s[after]):
                    heapq.heappush(heap, (m, k))
            if (before := left[k]) >= 0 and (m := rank_of(s[before] << 20 | s[k])):
                heapq.heappush(heap, (m, before))
        return [x for x in s if x >= 0]

    def encode_word(self, word: str) -> list[int]:
        data, ids = word.encode(), []
        starts = self.cuts(data) if len(data) > UNCUT else [0]
        for start, end in zip(starts, [*starts[1:], len(data)], strict=True):
            fragment = [self.byte_ids[b] for b in data[start:end]]
            if end == len(data):
                fragment[-1] = self.end_ids[data[-1]]
            ids += self.merge(fragment)
        return ids

    def pieces(self, text: str | None) -> list[tuple[bytes, int, str]]:
        """Packed ids, their number and their decoded text, piece by piece; pieces without ids are left out."""
        out: list[tuple[bytes, int, str]] = []
        for k, part in enumerate(self.at_special.split(text or "")):
            if k % 2:
                out.append((pack([self.special[part]]), 1, part))
                continue
            # Lower case is taken letter by letter, so a capital sigma never becomes a final one.
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            # No word holds white space, so what stands between white space is remembered as one piece.
            words = plain.split() if ODD_SPACE.isdisjoint(plain) else filter(None, SPACE_RUN.split(plain))
            out += map(self.known.__getitem__, words)
        return out

    def encode_packed(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join([p[0] for p in self.pieces(text)])

    def encode_piece(self, piece: str) -> tuple[bytes, int, str]:
        ids = [i for word in self.words.findall(piece) for i in self.known_words[word]]
        return pack(ids), len(ids), self.decode(ids)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """As a vocabulary without a decoder is decoded: the tokens, joined by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


class Known(dict):
    """What `encode` gives (for a piece packed ids, their number and decoded text; for a word its ids); works out and remembers what is missing."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[bytes, int, str] | list[int]:
        got = self.encode(piece)
        if len(piece) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = got
        return got


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One encoder a worker and file; workers stay alive between tasks."""
    return WordBpe(path)


#: What `encode_documents` can return, with types.
RESULTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", results: list[str] | None = None) -> DataFrame:
    """The id and the named results (all of RESULTS, unless named) of every row's whole text.

    The vocabulary file is read by each worker from `path`, which every executor must have. What is not asked for is
    not sent from the workers."""
    wanted = results or list(RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            pieces = [bpe.pieces(t) for t in batch.column(1).to_pylist()]
            packed = [b"".join([p[0] for p in x]) for x in pieces]
            decoded = [" ".join([p[2] for p in x if p[1]]) for x in pieces] if {"decoded", "decoded_sha256"} & set(wanted) else []
            by = {
                "ids": lambda: pa.array([np.frombuffer(x, "<u4").astype("i4") for x in packed], pa.list_(pa.int32())),
                "n_tokens": lambda: pa.array([len(x) // 4 for x in packed], pa.int64()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                "decoded": lambda: pa.array(decoded, pa.string()),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), *(by[c]() for c in wanted)], names=["id", *wanted])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{c} {RESULTS[c]}" for c in wanted)])
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema).withColumnRenamed("id", id_col)
