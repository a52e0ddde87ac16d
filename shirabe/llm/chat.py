"""Chat formatting by token-level assembly.

A turn is `<s>[INST]role[/INST]text</s>`. Roles and texts are encoded by themselves and the four
control strings are spliced in as reserved ids, the first four above the tokenizer's vocabulary, so no text can ever produce
one. Control strings that occur in a role or a text are also escaped, reversibly, so that the
rendered form is unambiguous too: the escape character is doubled, and one is put behind the first
character of a control string.

Segments are encoded where their rows lie; a turn's place in its conversation (ids and characters
before it) and the loss mask, which covers the texts of the assistant, follow from prefix sums over
the segments' lengths. The output is one row for each turn, so a conversation of any length is
never gathered; readers stream the turns of a conversation in order.

Cases: a null role or text is empty; null conversations and turns come first in order; equal turn
numbers are put in order of role, then of the SHA-256 of the text; repeated rows are turns of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shirabe.llm import encoding
from shirabe.llm.storage import store

#: Fixed values of the template.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, OPEN, CLOSE, END)
#: More strings that other templates reserve; they are escaped in texts as well.
FOREIGN = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"
ASSISTANT = "assistant"

_CONTROL = re.compile("|".join(re.escape(s) for s in sorted(CONTROLS + FOREIGN, key=len, reverse=True)))
_ESCAPED = re.compile(f"{ESCAPE}(.?)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    return _ESCAPED.sub(lambda m: m[1], text)


def escaped(texts: pa.Array) -> pa.Array:
    """Null as '', and texts with control strings or the escape character escaped; no work for others."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, pattern=_CONTROL.pattern + "|" + ESCAPE)
    if not pc.any(odd, min_count=0).as_py():
        return texts
    return pc.replace_with_mask(texts, odd, pa.array([escape(t) for t in texts.filter(odd).to_pylist()], texts.type))


def reserved(control: str, first: int) -> bytes:
    return (first + CONTROLS.index(control)).to_bytes(4, "little")


def format_turns(
    conversations: DataFrame, tokenizer: str, kind: str = encoding.SPACE_PREFIX, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each turn: conv_id, place (from 0), n_ids, n_chars (rendered), text_from and
    text_to (ids of the turn that are its text), loss (whether the mask covers them) and ids."""
    conv_type = conversations.schema[conv_id].dataType.simpleString()
    turn_type = conversations.schema[turn].dataType.simpleString()
    fixed = sum(map(len, CONTROLS))
    first = encoding.vocabulary(tokenizer)
    begin, open_, close, end = (reserved(c, first) for c in CONTROLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer, kind)
        for batch in batches:
            roles, texts = escaped(batch.column(2)), escaped(batch.column(3))
            role_ids, text_ids = enc.encode(roles), enc.encode(texts)
            role_n, text_n = (pc.binary_length(x).to_numpy(zero_copy_only=False) // 4 for x in (role_ids, text_ids))
            # Places inside a turn: begin, open, role, close, text, end.
            at = 3 + role_n
            ids = pc.binary_join_element_wise(pa.scalar(begin + open_, pa.large_binary()), role_ids, pa.scalar(close, pa.large_binary()), text_ids, pa.scalar(end, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            chars = fixed + sum(pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (roles, texts))
            assistant = pc.equal(pc.fill_null(batch.column(2), ""), ASSISTANT)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column(4), pa.array(chars), pa.array(at + text_n + 1), pa.array(at), pa.array(at + text_n), assistant, ids.cast(pa.binary())],
                ["conv_id", "turn", "role", "tie", "n_chars", "n_ids", "text_from", "text_to", "loss", "ids"],
            )

    fields = f"conv_id {conv_type}, turn {turn_type}, role string, tie string, n_chars bigint, n_ids bigint, text_from bigint, text_to bigint, loss boolean, ids binary"
    body = F.coalesce(F.col(text), F.lit(""))
    own = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), body.alias("text"), F.sha2(body, 256).alias("tie"))
    turns = store(own.mapInArrow(run, fields), "chat-turns")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n_ids", "n_chars")]
    return turns.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "n_chars", "n_ids", *sums, "text_from", "text_to", "loss", "ids")


def read_turns(ids: np.ndarray, bounds: np.ndarray, decoder: encoding.Decoder, first: int) -> tuple[list[str], list[str]]:
    """Roles and texts, still escaped, of turns whose ids stand between bounds; all are decoded at once."""
    begin, open_, close, end = (first + i for i in range(4))
    reserved_at = np.flatnonzero(ids >= first)
    n = len(bounds) - 1
    if len(reserved_at) != 4 * n:
        raise ValueError("not turns of this template")
    at = reserved_at.reshape(n, 4)
    lo, hi = bounds[:-1], bounds[1:]
    if (ids[at] != [begin, open_, close, end]).any() or (at[:, 0] != lo).any() or (at[:, 1] != lo + 1).any() or (at[:, 3] != hi - 1).any():
        raise ValueError("not turns of this template")
    # Ids without the reserved ones: role and text of each turn in turn.
    sizes = np.stack([at[:, 2] - at[:, 1] - 1, at[:, 3] - at[:, 2] - 1], axis=1).reshape(-1)
    texts = decoder.decode(ids[ids < first], np.concatenate([[0], np.cumsum(sizes)]))
    return texts[::2], texts[1::2]


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each conversation, decoded from the ids alone. Turns stream through in order, so
    memory holds one batch of turns."""
    conv_type = formatted.schema["conv_id"].dataType.simpleString()
    key_type = to_arrow_type(formatted.schema["conv_id"].dataType)
    first = encoding.vocabulary(tokenizer)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    fixed = sum(map(len, CONTROLS))

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str, str | None]]:
        decoder = encoding.decoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                data = part.column(4).cast(pa.large_binary())
                offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
                ids = np.frombuffer(data.buffers()[2], np.uint32, (offsets[-1] - offsets[0]) // 4, offsets[0])
                bounds = (offsets - offsets[0]) // 4
                roles, texts = read_turns(ids, bounds, decoder, first)
                # The mask covers the ids from text_from to text_to: where that is the text segment, its
                # decoding serves; any other stretch is decoded by itself.
                start, stop = part.column(1).to_numpy(), part.column(2).to_numpy()
                sizes = np.diff(bounds)
                segment = np.flatnonzero(ids == first + 2) - bounds[:-1] + 1
                whole = (start == segment) & (stop == sizes - 1)
                for i, (conv, masked) in enumerate(zip(part.column(0).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    loss = None
                    if masked:
                        loss = texts[i] if whole[i] else decoder.decode(ids[bounds[i] + start[i] : bounds[i] + stop[i]], np.array([0, stop[i] - start[i]]))[0]
                    yield conv, roles[i], texts[i], loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, own in groupby(turns(batches), key=lambda t: t[0]):
            every, loss, n, lost, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, role, text, masked in own:
                every.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                n, chars = n + 1, chars + fixed + len(role) + len(text)
                if masked is not None:
                    part = unescape(masked)
                    loss.update(part.encode())
                    lost += len(part)
            out.append((conv, n, every.hexdigest(), lost, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        keys, *rest = zip(*out, strict=True)
        types = [pa.string() if n.endswith("sha256") else pa.int64() for n in names[1:]]
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names)

    ordered = formatted.select("conv_id", "place", "text_from", "text_to", "loss", "ids").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.drop("place").mapInArrow(run, f"conv_id {conv_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
