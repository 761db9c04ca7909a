"""Chat formatting with offset-aligned loss masks.

A conversation is rendered turn by turn, `<|im_start|>role<|im_sep|>text<|im_end|>`, and every turn is encoded once
with character offsets. The span of an assistant text is intersected with the sorted token spans by binary
search. The three marks are special tokens, so no token crosses the edge of a turn or a text, and the tokens of the
turns are those of the whole conversation.

Turns reach a task in order, by a shuffle and an external sort, and are folded as they come: a task holds one turn's
tokens and what the fold keeps (`Whole`: one conversation's output; `Digest`: two hashes and three counts).

Control strings inside roles and texts are escaped reversibly: `<`, any number of backslashes and `|` get one
backslash more, so that an escaped text holds no `<|`.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the texts to learn from."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == LOSS_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns again, from the output of render()."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span: for each span, two binary searches in the sorted token edges."""
    mask = np.zeros(len(starts), dtype=bool)
    for lo, hi in spans:
        mask[np.searchsorted(ends, lo, "right") : np.searchsorted(starts, hi, "left")] = True
    return mask


def covered(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges under the mask, merged; tokens of parts of one character share its range."""
    lo, hi = starts[mask], np.maximum.accumulate(ends[mask])
    if not len(lo):
        return []
    first = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    last = np.append(first[1:], len(lo)) - 1
    return list(zip(lo[first].tolist(), hi[last].tolist(), strict=True))


_loaded: dict = {}


def load_tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep the spaces
        t.add_special_tokens([AddedToken(x, normalized=False) for x in (START, SEP, END)])
        _loaded[path] = t
    return _loaded[path]


def encode_turn(t, role: str, text: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A turn's formatted text, token ids, token starts and ends in that text, and mask."""
    formatted, spans = render([(role, text)])
    e = t.encode(formatted, add_special_tokens=False)
    edges = np.fromiter(itertools.chain.from_iterable(e.offsets), dtype=np.int32, count=2 * len(e))
    starts, ends = edges[::2], edges[1::2]
    return formatted, np.array(e.ids, dtype=np.int32), starts, ends, mask_tokens(starts, ends, spans)


class Whole:
    """The output of a conversation."""

    columns = "formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"

    def __init__(self) -> None:
        self.turns, self.chars = [], 0

    def add(self, formatted: str, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> None:
        self.turns.append((formatted, ids, starts + self.chars, ends + self.chars, mask))
        self.chars += len(formatted)

    def row(self) -> tuple:
        formatted, *arrays = zip(*self.turns, strict=True)
        return "".join(formatted), *map(np.concatenate, arrays)


class Digest:
    """What the output says, read back from it turn by turn."""

    columns = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> None:
        turns = parse(formatted)
        loss = "".join(unescape(formatted[lo:hi]) for lo, hi in covered(starts, ends, mask))
        self.turns.update("".join(f"{r}\n{x}\n" for r, x in turns).encode())
        self.loss.update(loss.encode())
        self.n_turns += len(turns)
        self.loss_chars += len(loss)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


#: Formatted characters after which a task hands on the conversations it has finished.
FRAME_CHARS = 1 << 20


def fold_turns(batches: Iterator[pd.DataFrame], tokenizer: str, into: type) -> Iterator[pd.DataFrame]:
    """Rows of conversations from their turns, which lie together and in order but may go on in the next batches."""
    t = load_tokenizer(tokenizer)
    names = ["conv_id", *(x.split()[0] for x in into.columns.split(", "))]
    turns = (x for batch in batches for x in zip(batch["conv_id"], batch["role"], batch["text"], strict=True))
    rows, chars = [], 0
    for conv, own in itertools.groupby(turns, key=lambda x: None if pd.isna(x[0]) else x[0]):
        state = into()
        for _, role, text in own:
            state.add(*encode_turn(t, role, text))
        rows.append((conv, *state.row()))
        chars += state.chars
        if chars >= FRAME_CHARS:
            yield pd.DataFrame(rows, columns=names)
            rows, chars = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def fold_conversations(conversations: DataFrame, into: type, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conv_id: conv_id and the columns of `into`, a class that is given each turn's output in order.

    Turns go by turn (nulls first), then role and text, so ties and repeated rows have one order; a null role
    or text is empty; rows of a null conv_id are one conversation. An empty table gives an empty result.
    A conversation is one task's work, since its hashes run through its turns; that costs time, not memory.
    """
    empty = lambda x: F.coalesce(x, F.lit("")).alias(x)
    turns = conversations.select("conv_id", "turn", empty("role"), empty("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    named = turns.select(F.col("conv_id").cast("string"), "role", "text")  # pandas has no null integers
    out = named.mapInPandas(lambda batches: fold_turns(batches, tokenizer, into), f"conv_id string, {into.columns}")
    return out.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))


def format_conversations(conversations: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conv_id: conv_id, formatted, token_ids, token_starts, token_ends, loss_mask; see fold_conversations.

    A row holds a conversation, so a task holds one at a time, and FRAME_CHARS of finished ones.
    """
    return fold_conversations(conversations, Whole, tokenizer=tokenizer)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(own).alias("text"))
    return fold_conversations(rows.unionByName(extra), Digest)
