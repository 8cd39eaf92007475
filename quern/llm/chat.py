"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, every turn as

    ### role:
    text
    </turn>

encoded once with offsets, and the loss mask comes from a binary search of the
sorted text spans of the assistant's turns in the sorted token spans. Inside texts
and roles a backslash goes before each backslash, # and < (in roles also before
colons, and line ends become \\n), so no text can hold a control string and reading
back restores every character. Control strings are cut off before the text is split into
words, so none of them shares a token with a text: what the mask covers is the texts of
the assistant's turns and nothing else, and reading back takes just what is under
it, without a look at roles.

Defined results: null texts and roles are empty; turns come by turn, then role, then
text, nulls first; a null conv_id is a conversation of its own; repeated rows are
repeated turns; empty texts have empty spans; a character of several tokens is under the
mask once; a conversation is rendered in one row, so it must fit one, whatever
the length of its texts; other columns, whatever their names, stay unread; no rows: no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEARN = "assistant"
#: Conversations of an output batch.
BATCH = 256
_END = "\n</turn>\n"
_HEAD = r"### ((?:[^\\:\n]|\\.)*):\n"
_TURN = re.compile(_HEAD)
FORMATTED = "conv_id bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<tinyint>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def render(turns: list[tuple[str | None, str | None]], learn: str = LEARN) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of what is to be learnt."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape_role(role or '')}:\n", escape(text or "")
        out += [head, body, _END]
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(_END)
    return "".join(out), spans


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for tokens that share a character with a span."""
    mask = np.zeros(len(starts), dtype=np.int8)
    if spans and len(starts):
        s = np.array(spans)
        for a, b, x, y in zip(np.searchsorted(ends, s[:, 0], side="right"), np.searchsorted(starts, s[:, 1], side="left"), *s.T):
            if x < y:
                mask[a:b] = 1
    return mask


def parse(formatted: str) -> list[tuple[str, int, int]]:
    """Role and span of the escaped text of each turn."""
    turns, at = [], 0
    while at < len(formatted):
        head = _TURN.match(formatted, at)
        end = formatted.index(_END, head.end() - 1) if formatted.startswith(_END, head.end() - 1) else formatted.index(_END, head.end())
        turns.append((unescape_role(head[1]), head.end(), max(end, head.end())))
        at = end + len(_END)
    return turns


def read_back(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> tuple[list[tuple[str, str]], str]:
    """The turns, and all text under the loss mask, whoever's it is."""
    turns = [(role, unescape(formatted[a:b])) for role, a, b in parse(formatted)]
    under = np.zeros(len(formatted) + 1, dtype=np.int32)
    on = loss.astype(bool)
    np.add.at(under, starts[on], 1)
    np.add.at(under, ends[on], -1)
    edges = np.flatnonzero(np.diff(np.cumsum(under)[:-1] > 0, prepend=False, append=False)).tolist()
    return turns, unescape("".join([formatted[a:b] for a, b in zip(edges[::2], edges[1::2])]))


def tokenizer(path: str):
    """The vocabulary's tokenizer, which cuts control strings off from what stands beside them."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers, processors

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(f"{_HEAD}|{_END}"), "isolated"), t.pre_tokenizer])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def conversations(batches):
    """Lists of (conv_id, [(role, text)]) from Arrow batches that are sorted by conversation."""
    now, turns, any_ = None, [], False
    for b in batches:
        for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            if any_ and conv != now:
                yield now, turns
                turns = []
            now, any_ = conv, True
            turns.append((role, text))
    if any_:
        yield now, turns


def formatted(rows: DataFrame, path: str, learn: str = LEARN) -> DataFrame:
    """A row per conversation: the text, its token ids, their spans and the loss mask."""

    def run(batches):
        import pyarrow as pa

        t, out = tokenizer(path), []

        def batch(out):
            cols = list(zip(*out))
            i32 = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), *(pa.array(cols[k], i32) for k in (2, 3, 4)), pa.array(cols[5], pa.list_(pa.int8()))], names=["conv_id", "formatted", "ids", "starts", "ends", "loss"])

        for conv, turns in conversations(batches):
            text, spans = render(turns, learn)
            e = t.encode(text, add_special_tokens=False)
            at = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            out.append((conv, text, np.array(e.ids, dtype=np.int32), at[:, 0], at[:, 1], loss_mask(at[:, 0], at[:, 1], spans)))
            if len(out) >= BATCH:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "role", "text", "turn")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, FORMATTED)


def digests(out: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""

    def run(batches):
        import pyarrow as pa

        hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            text = b.column(1).to_pylist()
            cols = [[], [], [], []]
            for k, f in enumerate(text):
                turns, under = read_back(f, *(np.asarray(b.column(c)[k].values) for c in (2, 3, 4)))
                for c, x in zip(cols, (len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), hexed(under))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array([len(f) for f in text], pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return out.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
