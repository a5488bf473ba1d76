"""Chat formatting assembled at token level.

Role and text of a turn are escaped and encoded separately, then spliced
between reserved ids that no encoded text can hold:

    BEGIN (TURN role TEXT text END)*

The loss mask comes from a prefix sum: +1 where an assistant's text
starts, -1 where it ends.  Control strings inside a text are broken by an
escape character after their first character, and the escape character
is doubled, so a text reads back exactly and the rendered form holds no
control string of the content either.

A turn is a row of its own from beginning to end, so a conversation of
any length needs no more memory than a batch.  Turns are dealt out by
ranges of (conversation, turn number): a long conversation lies in many
tasks, each of which numbers its turns and sums their tokens; what came in
the tasks before is added to them afterwards, a row per border.  Reading
back checks and decodes every turn where it is; only the digest over a
whole conversation, which is sequential, needs its texts in one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

# --- fixed values ---
ESCAPE = "␛"
BEGIN, TURN, TEXT, END = "<|begin|>", "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (BEGIN, TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]",
           "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|endoftext|>")
# The public split pattern of the byte-level vocabularies.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
         r"|\s+(?!\S)|\s+")
# --- end of fixed values ---
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(ESCAPE + "(.)", re.DOTALL)


@dataclass(frozen=True)
class ChatParams:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    loss_role: str = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:],
                        text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """The vocabulary with the four reserved ids after its last one."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b)
                     for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("chat", pat_str=SPLIT,
                                     mergeable_ranks=ranks,
                                     special_tokens={})
        self.begin, self.turn, self.text, self.end = range(
            max(ranks.values()) + 1, max(ranks.values()) + 5)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.enc.encode_ordinary(t) for t in texts]

    def decode(self, ids) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        return self.enc.decode_bytes(ids).decode()

    @staticmethod
    @lru_cache(maxsize=4)
    def at(path: str) -> Codec:
        return Codec(path)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column as views of its values."""
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


TURNS = ("conv_id long, turn long, task int, place long, first_token long, "
         "tokens array<int>, loss binary")


def _encode_turns(p: ChatParams):
    """Sorted turns encoded; place and first token count from the first
    turn of the conversation that the task has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(p.vocabulary)
        task = TaskContext.get().partitionId()
        conv, n, at = object(), 0, 0
        for batch in batches:
            roles = batch.column(2).to_pylist()
            texts = batch.column(3).to_pylist()
            rows = []
            for c, turn, role, r, t in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                    roles, codec.encode([escape(x) for x in roles]),
                    codec.encode([escape(x) for x in texts]), strict=True):
                if c != conv:
                    conv, n, at = c, 0, 0
                ids = np.array([codec.turn, *r, codec.text, *t, codec.end],
                               np.int32)
                step = np.zeros(len(ids) + 1, np.int8)
                if role == p.loss_role:
                    step[2 + len(r)] += 1
                    step[2 + len(r) + len(t)] -= 1
                mask = np.cumsum(step[:-1], dtype=np.int8).tobytes()
                rows.append((c, turn, task, n, at, ids, mask))
                n, at = n + 1, at + len(ids)
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                     pa.int64(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=[c.split()[0] for c in TURNS.split(", ")])
    return run


def format_turns(conversations: DataFrame, params: ChatParams = ChatParams()
                 ) -> DataFrame:
    """The formatted conversations, one row per turn in ``place`` order:
    conv_id, turn, place, first_token, tokens, loss (a byte per token).

    Turns are ordered by (turn, role, text), null turns first; a null role
    or text is empty; rows with a null conv_id are one conversation.
    Repeated rows are turns of their own.  No rows give no rows.
    """
    rows = C.own_columns(conversations, {
        "conv_id": "conv_id", "turn": "turn", "role": "role",
        "text": "text"}).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
          for c in ("role", "text")])
    return C.result_of(lambda: _format(rows, params),
                       conversations.sparkSession, "chat")


def _format(rows: DataFrame, p: ChatParams) -> DataFrame:
    # turns of equal number stay together, to be ordered by role and text
    turns = C.save(rows.repartitionByRange("conv_id", "turn")
                   .sortWithinPartitions("conv_id", "turn", "role", "text")
                   .mapInArrow(_encode_turns(p), TURNS), "chat-turns")
    parts = turns.groupBy("conv_id", "task").agg(
        F.count("*").alias("turns"),
        F.sum(F.size("tokens")).alias("ids"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    # only a conversation that crosses a border of tasks has earlier turns:
    # at most a row per task
    earlier = C.cut(parts.select(
        F.col("conv_id").alias("conv"), "task",
        F.sum("turns").over(before).alias("turns"),
        F.sum("ids").over(before).alias("ids")).where("turns > 0"))
    tasks = earlier.withColumnRenamed("task", "t")
    rows = turns.join(F.broadcast(tasks), F.col("conv_id").eqNullSafe(
        F.col("conv")) & (F.col("task") == F.col("t")), "left")
    place = F.col("place") + F.coalesce("turns", F.lit(0))
    first = place == 0
    begin = Codec.at(p.vocabulary).begin
    # the id that begins a conversation stands before its first turn
    at = (F.col("first_token") + F.coalesce("ids", F.lit(0))
          + F.when(first, 0).otherwise(1))
    return rows.select(
        "conv_id", "turn", place.alias("place"), at.alias("first_token"),
        F.when(first, F.concat(F.array(F.lit(begin)), "tokens"))
        .otherwise(F.col("tokens")).alias("tokens"),
        F.when(first, F.concat(F.lit(b"\0"), "loss"))
        .otherwise(F.col("loss")).alias("loss"))


READ = "conv_id long, place long, said binary, learnt binary, shown long"


def _read_turns(p: ChatParams):
    """Each turn from its ids and mask alone: what it says (role, newline,
    text, newline), what the mask covers, and its rendered length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(p.vocabulary)
        names_of = {codec.begin: BEGIN, codec.turn: TURN, codec.text: TEXT,
                    codec.end: END}
        for batch in batches:
            said, learnt, shown = [], [], []
            for c, place, ids, mask in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                    _lists(batch.column(2)), batch.column(3).to_pylist(),
                    strict=True):
                cuts = np.flatnonzero(ids >= codec.begin)
                marks = [names_of[i] for i in ids[cuts].tolist()]
                if marks != [BEGIN][place > 0:] + [TURN, TEXT, END]:
                    raise ValueError(f"conversation {c}: ids out of place")
                a, b, e = cuts[-3:]
                role = codec.decode(ids[a + 1:b])
                text = codec.decode(ids[b + 1:e])
                said.append(f"{unescape(role)}\n{unescape(text)}\n".encode())
                # what the mask covers, whatever the role says
                learnt.append(unescape(codec.decode(
                    ids[np.frombuffer(mask, np.int8) == 1])).encode())
                shown.append(sum(map(len, marks)) + len(role) + len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array(said, pa.binary()), pa.array(learnt, pa.binary()),
                 pa.array(shown, pa.int64())],
                names=[c.split()[0] for c in READ.split(", ")])
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation, from its turns in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars",
             "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(),
             pa.int64()]
    state, done = None, []

    def close():
        c, n, turns, chars, loss, shown = state
        done.append((c, n, turns.hexdigest(), chars, loss.hexdigest(), shown))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [()] * 6
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
            names=names)

    for batch in batches:
        for c, place, said, learnt, shown in zip(*[
                batch.column(k).to_pylist() for k in range(5)], strict=True):
            if state is None or state[0] != c:
                if state is not None:
                    close()
                state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if place != state[1]:
                raise ValueError(f"conversation {c}: turn {place} is not "
                                 f"the next after {state[1]}")
            state[1] += 1
            state[2].update(said)
            state[3] += len(learnt.decode())
            state[4].update(learnt)
            state[5] += shown
        if len(done) >= 1000:
            yield flush()
    if state is not None:
        close()
    yield flush()


def read_back(formatted: DataFrame, params: ChatParams = ChatParams()
              ) -> DataFrame:
    """Per conversation, from the token ids and the mask alone: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = formatted.select("conv_id", "place", "tokens", "loss").mapInArrow(
        _read_turns(params), READ)
    return turns.repartition("conv_id").sortWithinPartitions(
        "conv_id", "place").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, "
        "loss_chars long, loss_sha256 string, formatted_chars long")
