"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of its turns meet the token spans by binary search:
a token is under the loss mask if it lies in an assistant's text.

A turn is `<|im_start|>` role `<|im_sep|>` text `<|im_end|>`. The three marks are tokens of their own, so no token
crosses from a mark into a text. A control string inside a role or text gets a backslash after its first character and every
backslash is doubled, so the marks are found only where the template put them, and unescaping is exact.

Defined results: null roles and texts are empty; rows are ordered by turn, then role and text, nulls first; rows with a null conversation id form one conversation;
repeated rows are turns of their own; an empty table gives an empty result. A conversation is the unit of rendering, as a training example must be: one task holds it whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that some template takes as control; none is left as it is inside a text.
CONTROLS = (START, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)
TOKENIZER = os.environ.get("SITESIFT_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)  # each turn's text, in order
    roles: list[str] = field(default_factory=list)


def render(turns: list[tuple[str, str]]) -> Rendered:
    out, parts, at = Rendered(""), [], 0
    for role, text in turns:
        head, body = START + escape(role) + MIDDLE, escape(text)
        out.spans.append((at + len(head), at + len(head) + len(body)))
        out.roles.append(role)
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    out.text = "".join(parts)
    return out


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a rendered conversation holds."""
    turns = []
    for turn in formatted.split(START)[1:]:
        head, _, body = turn.partition(MIDDLE)
        turns.append((unescape(head), unescape(body.removesuffix(END))))
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]], wanted: list[bool]) -> np.ndarray:
    """Which tokens lie in a wanted span. offsets: tokens x 2, sorted; spans: sorted, apart from each other.

    For each token the last span that starts at or before it is found by binary search.
    """
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    begins, ends = np.array(spans).T
    at = np.searchsorted(begins, offsets[:, 0], "right") - 1
    inside = (at >= 0) & (offsets[:, 1] <= ends[at]) & (offsets[:, 1] > offsets[:, 0])
    return inside & np.array(wanted)[at]


def masked_text(formatted: str, offsets: np.ndarray, loss: np.ndarray) -> str:
    """The text under the mask, unescaped: tokens that share a character (parts of its bytes) give it once."""
    parts, at, open_at = [], -1, -1
    for a, b in offsets[loss].tolist():
        if a > at and at >= 0:
            parts.append(formatted[open_at:at])
            open_at = a
        elif at < 0:
            open_at = a
        at = max(at, b)
    parts.append(formatted[open_at:at] if at >= 0 else "")
    return "".join(map(unescape, parts))


_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The vocabulary with the three marks added as special tokens; loaded once a process."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([START, MIDDLE, END])
        _LOADED[path] = t
    return _LOADED[path]


def format_conversations(conversations: DataFrame, tokenizer_path: str = TOKENIZER, loss_roles: tuple[str, ...] = ("assistant",), rows: int = 64) -> DataFrame:
    """conv_id, formatted, ids, loss (a flag for each token), offsets' effect read back: turns (role, text) and loss_text.

    conversations: conv_id, turn, role, text.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
                out: dict[str, list] = {"ids": [], "loss": [], "turns": [], "loss_text": []}
                for r, e in zip(made, encode.encode_batch([r.text for r in made], add_special_tokens=False), strict=True):
                    spans = np.array(e.offsets, np.int64).reshape(-1, 2)
                    loss = mask(spans, r.spans, [role in loss_roles for role in r.roles])
                    out["ids"].append(e.ids)
                    out["loss"].append(loss.tolist())
                    out["turns"].append([{"role": a, "text": b} for a, b in parse(r.text)])
                    out["loss_text"].append(masked_text(r.text, spans, loss))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([r.text for r in made], pa.string()), pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["loss"], pa.list_(pa.bool_())), pa.array(out["turns"], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(out["loss_text"], pa.string())],
                    names=["conv_id", "formatted", "ids", "loss", "turns", "loss_text"],
                )

    return grouped.mapInArrow(run, "conv_id long, formatted string, ids array<int>, loss array<boolean>, turns array<struct<role: string, text: string>>, loss_text string")


def digests(formatted: DataFrame) -> DataFrame:
    """What was read back, as digests."""
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return formatted.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
