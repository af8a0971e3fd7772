"""Chat formatting by token-level assembly.

A conversation becomes one sequence of token ids. Roles and texts are encoded segment by segment, so no
token spans two segments, and reserved ids, which no text can produce, are spliced between them:

    <s>                                                  once, before the first turn
    [INST] role [ROLE] text [/INST]                      a turn of any role but assistant
    [INST] role [ROLE] text </s>                         a turn of the assistant

Lengths of segments give, by prefix sums, each segment's place in the sequence; the loss mask is the prefix sum over +1
where the text of an assistant turn starts and -1 where it ends. Control strings that occur inside texts are escaped, so
the rendered form is unambiguous too: each gets one more backslash after its first character, which reading back removes.

Each conversation's turns are brought together and ordered within a partition by one shuffle; a pass that holds one batch
encodes and numbers them, and reading back what it has just written needs no second shuffle. So a conversation of any
length takes no more memory than a short one, though its turns are numbered by one task, as its digests must be.

Cases: a null text or role is empty. Turns are ordered by turn (nulls first), then role and text, so ties and
repeated rows have a fixed order and all are kept. A null conversation id is a conversation of its own. Empty
tables give empty results. Of the input only the four named columns are used.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings, in the order of their reserved ids.
BEGIN, TURN, ROLE, END_TURN, END = CONTROLS = ("<s>", "[INST]", "[ROLE]", "[/INST]", "</s>")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def reserved(path: str) -> list[int]:
    """Ids above the vocabulary for the control strings."""
    first = _tokenizer(path).get_vocab_size(with_added_tokens=True)
    return list(range(first, first + len(CONTROLS)))


FORMATTED = "conv_id long, seq long, start long, ids array<int>, mask array<byte>, chars long"
#: Segments that a worker remembers; roles are few.
REMEMBERED = 10_000


class Remembered(dict):
    """What a function gives for short keys that come again and again."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = got = self.find(key)
        return got


def _listed(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat, kind))


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (begin, turn, role, end_turn, end) = _tokenizer(path), reserved(path)
        role_ids = Remembered(lambda r: t.encode(escape(r), add_special_tokens=False).ids)
        conv, seq, place = object(), 0, 0
        for batch in batches:
            convs, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            shown = [escape(x) for x in texts]
            text_ids = [e.ids for e in t.encode_batch_fast(shown, add_special_tokens=False)]
            flat: list[int] = []
            lengths, numbers, starts, chars, marks = [], [], [], [], []
            for c, r, x, ids in zip(convs, roles, shown, text_ids, strict=True):
                if c != conv:
                    conv, seq, place = c, 0, 0
                before, loss = len(flat), r == "assistant"
                flat += ([begin, turn] if seq == 0 else [turn]) + role_ids[r]
                flat.append(role)
                if loss:
                    marks.append((len(flat), len(flat) + len(ids)))
                flat += ids
                flat.append(end if loss else end_turn)
                lengths.append(len(flat) - before)
                numbers.append(seq)
                starts.append(place)
                chars.append(len(TURN) + len(escape(r)) + len(ROLE) + len(x) + len(END if loss else END_TURN) + (0 if seq else len(BEGIN)))
                seq, place = seq + 1, place + lengths[-1]
            change = np.zeros(len(flat) + 1, "i1")
            at = np.array(marks, "i8").reshape(-1, 2)
            np.add.at(change, at[:, 0], 1)
            np.add.at(change, at[:, 1], -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), _listed(np.array(flat, "i4"), lengths, pa.int32()),
                    _listed(np.cumsum(change, dtype="i1")[:-1], lengths, pa.int8()), pa.array(chars, pa.int64()),
                ],
                names=["conv_id", "seq", "start", "ids", "mask", "chars"],
            )

    return run


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *order)


def format_conversations(turns: DataFrame, path: str) -> DataFrame:
    """A row for each turn: conv_id, seq (from 0), start (place of its first id in the conversation's sequence),
    ids, mask (1 for each id that the loss counts, else 0), chars (code points of its rendered form). The concatenated ids of
    a conversation, by seq, are its sequence; rows of one conversation follow each other in this order."""
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    )
    return _in_order(rows, "turn", "role", "text").mapInArrow(_assemble(path), FORMATTED)


def _rows(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """Values of a list column, and where each list starts and ends among them."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()


def _read_back(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (begin, turn, role, end_turn, end) = _tokenizer(path), reserved(path)
        plain = Remembered(lambda ids: unescape(t.decode(list(ids), skip_special_tokens=False)))
        now = None

        def done() -> tuple:
            return (now["conv"], now["turns"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], now["ids"])

        for batch in batches:
            rows: list[tuple] = []
            (ids, at), (mask, _) = _rows(batch.column("ids")), _rows(batch.column("mask"))
            masked, spans, texts = mask > 0, [], []
            for a, b in zip(at, at[1:], strict=False):
                mine = ids[a:b]
                m = int(np.flatnonzero(mine == role)[0])
                k = int(mine[0] == begin)
                if mine[k] != turn or mine[-1] not in (end, end_turn):
                    raise ValueError("not a formatted turn")
                spans.append((k + 1, m))
                texts.append(mine[m + 1 : -1].tolist())
            # What the mask covers is mostly a turn's whole text; it is decoded by itself where it is not.
            learnt = [ids[a:b][masked[a:b]].tolist() for a, b in zip(at, at[1:], strict=False)]
            said = [unescape(x) for x in t.decode_batch(texts, skip_special_tokens=False)]
            for n, (c, chars) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("chars").to_pylist(), strict=True)):
                if now is None or c != now["conv"]:
                    if now is not None:
                        rows.append(done())
                    now = {"conv": c, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "ids": 0}
                who = plain[tuple(ids[at[n] + spans[n][0] : at[n] + spans[n][1]].tolist())]
                now["turns"] += 1
                now["all"].update(f"{who}\n{said[n]}\n".encode())
                if learnt[n]:
                    part = said[n] if learnt[n] == texts[n] else unescape(t.decode(learnt[n], skip_special_tokens=False))
                    now["loss"].update(part.encode())
                    now["loss_chars"] += len(part)
                now["chars"] += chars
                now["ids"] += at[n + 1] - at[n]
            yield _digests(rows)
        if now is not None:
            yield _digests([done()])

    return run


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long"


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=names)


def read_back(formatted: DataFrame, path: str, in_order: bool = False) -> DataFrame:
    """What the ids of each conversation say: number of turns, digests of turns and of the text under the loss
    mask, decoded and unescaped. `in_order` says that `formatted` comes straight from `format_conversations`, whose rows follow
    each other; otherwise they are brought together first."""
    return (formatted if in_order else _in_order(formatted, "seq")).mapInArrow(_read_back(path), DIGESTS)


#: A control string with any number of backslashes after its first character.
_CONTROL_SQL = r"([<\[])(\\*)(s>|INST\]|ROLE\]|/INST\]|/s>)"

SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(12 + length(role) + length(regexp_extract_all(role, '{_CONTROL_SQL}')) + length(text) + length(regexp_extract_all(text, '{_CONTROL_SQL}'))
     + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END))::bigint AS formatted_chars
FROM c GROUP BY conv_id
"""
