"""Conversations as one token sequence each, built from separately encoded segments.

A turn is `### role: text</turn>\n`. The three marks are reserved ids above the vocabulary, spliced between the ids of
role and text; no text can yield them. So that the written form is reversible too, a backslash goes before each control
string (and backslash) inside a role or text. Where a segment lies in its conversation comes from prefix sums over the
turns, so a conversation of any length stays spread over rows: one row per turn.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Written form of the reserved marks, in the order of their ids.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
MARKS = (OPEN, COLON, CLOSE)
CONTROL = re.compile(r"\\|###|</turn>|: ")
UNESCAPE = re.compile(r"\\(\\|###|</turn>|: )")
LOSS_ROLE = "assistant"

SEGMENTS = "conv_id bigint, turn bigint, role string, text string, token_ids array<int>, mask_from int, mask_to int, n_chars bigint"


def escape(s: str) -> str:
    return CONTROL.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return UNESCAPE.sub(r"\1", s)


class Template:
    """Encodes turns and reads them back, for a rank file of byte-level pieces."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.first = max(ranks.values()) + 1
        self.codec = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def turn(self, role: str | None, content: str | None) -> tuple[list[int], int, int, int]:
        """ids, the ids' run under the loss mask, and the code points of the written form."""
        r, t = escape(role or ""), escape(content or "")
        head = [self.first, *self.codec.encode_ordinary(r), self.first + 1]
        body = self.codec.encode_ordinary(t)
        ids = [*head, *body, self.first + 2]
        lost = len(body) if role == LOSS_ROLE else 0
        return ids, len(head), len(head) + lost, len(r) + len(t) + sum(map(len, MARKS))

    def read(self, ids: np.ndarray) -> tuple[str, str, str]:
        """Role, text and written form of one turn's ids."""
        colon = int(np.flatnonzero(ids == self.first + 1)[0])
        role, content = self.codec.decode(ids[1:colon].tolist()), self.codec.decode(ids[colon + 1 : -1].tolist())
        return unescape(role), unescape(content), OPEN + role + COLON + content + CLOSE

    def text(self, ids: np.ndarray) -> str:
        return unescape(self.codec.decode(ids.tolist()))


def assemble(turns: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, token_ids (marks included), mask_from and mask_to (the run of ids
    in the turn that carries loss; empty for roles other than assistant), n_chars, and start, the position of the
    turn's first id in its conversation.

    Null roles and texts count as empty. Rows with the same turn number all stay, ordered by role and text; a null
    conv_id is a conversation of its own, a null turn comes first. Other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(ranks_path, pattern)
        for batch in batches:
            rows = batch.to_pydict()
            made = [template.turn(r, t) for r, t in zip(rows["role"], rows["text"])]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([m[0] for m in made], pa.list_(pa.int32())),
                    *[pa.array([m[k] for m in made], pa.int32()) for k in (1, 2)],
                    pa.array([m[3] for m in made], pa.int64()),
                ],
                names=[*batch.schema.names, "token_ids", "mask_from", "mask_to", "n_chars"],
            )

    picked = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    made = picked.mapInArrow(run, SEGMENTS)
    return made.withColumn("start", F.coalesce(F.sum(F.size("token_ids").cast("bigint")).over(before), F.lit(0)))


def digest(segments: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What the assembled ids say, read back: one row per conversation with n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars and n_tokens. Tasks stream over rows sorted by position and keep hash states only."""

    def close(state) -> dict:
        conv, n, said, lost_chars, lost, chars, tokens = state
        return {"conv_id": conv, "n_turns": n, "turns_sha256": said.hexdigest(), "loss_chars": lost_chars, "loss_sha256": lost.hexdigest(), "formatted_chars": chars, "n_tokens": tokens}

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows)
        out["conv_id"] = out["conv_id"].astype("Int64")
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template, state, fresh = Template(ranks_path, pattern), None, True
        for pdf in frames:
            done = []
            for conv, start, ids, a, b in zip(pdf["conv_id"].astype("Int64"), pdf["start"], pdf["token_ids"], pdf["mask_from"], pdf["mask_to"]):
                conv = None if pd.isna(conv) else int(conv)
                if fresh or conv != state[0]:
                    if not fresh:
                        done.append(close(state))
                    state, fresh = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], False
                if start != state[6]:
                    raise ValueError(f"conversation {conv}: a turn starts at {start}, not at {state[6]}")
                role, content, written = template.read(ids)
                lost = template.text(ids[a:b])
                state[1] += 1
                state[2].update(f"{role}\n{content}\n".encode("utf-8"))
                state[3] += len(lost)
                state[4].update(lost.encode("utf-8"))
                state[5] += len(written)
                state[6] += len(ids)
            if done:
                yield frame(done)
        if not fresh:
            yield frame([close(state)])

    rows = segments.select("conv_id", "start", "token_ids", "mask_from", "mask_to")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.mapInPandas(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint")


def written(segments: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """segments with `written`, the turn in its written form."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields) + ", written string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = Template(ranks_path, pattern)
        for pdf in frames:
            yield pdf.assign(written=[template.read(ids)[2] for ids in pdf["token_ids"]])

    return segments.mapInPandas(run, fields)
