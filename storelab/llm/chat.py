"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``<turn>role<text>text</turn>``, a conversation as its turns one after
the other. Inside a role or a text a backslash becomes two and the first character of a
control string becomes ``\\l``, so a control string in the output is always a mark and the
original comes back exactly.

Rendered conversations are encoded once, with the offsets of every token. The control
strings are tokens of their own, so no token crosses the border of a text. The spans of the
turns are sorted, so the span that a token may lie in is found by binary search; tokens
inside the text of an assistant are under the loss mask.

Rows are range partitioned by (conv_id, turn, content) and sorted, so each task streams over
its part of the order and holds one piece at a time: whole turns up to ``PIECE_CHARS``
characters. Most conversations are one piece; a longer one, or one that a partition border
cuts, is several, in order. Texts longer than ``SLICE_CHARS`` are encoded in slices that end
between a letter and a blank before a letter, where this tokenizer always splits, so the
ids are the same.

Defined results: a null role or text is empty; turns come in ascending order, null first,
turns of equal number by the md5 of role and text; repeated rows are turns of their own; a
null ``conv_id`` is one conversation; only the role ``assistant``, written so, is trained on;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelab.llm.tokens import tokenizer_path
from storelab.session import cut

BYTE_TOKENIZER = "byte_bpe_50k.json"
TURN, TEXT, END = "<turn>", "<text>", "</turn>"
TRAINED_ROLE = "assistant"
PIECE_CHARS = 1 << 18
SLICE_CHARS = 1 << 16
BATCH_CHARS = 1 << 19

_MARKED = re.compile(r"\\|<(?=turn>|text>|/turn>)")
_ESCAPED = re.compile(r"\\(.)")
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def escaped(text: str) -> str:
    return _MARKED.sub(lambda m: "\\\\" if m[0] == "\\" else "\\l", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" if m[1] == "l" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The rendered turns and, in order, start and end of each text and whether it is trained on."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escaped(role)}{TEXT}", escaped(text)
        spans.append((at + len(head), at + len(head) + len(body), role == TRAINED_ROLE))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for part in rendered.split(END)[:-1]:
        role, text = part.removeprefix(TURN).split(TEXT, 1)
        turns.append((unescaped(role), unescaped(text)))
    return turns


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, bool]]) -> np.ndarray:
    """Which tokens lie in a trained span: the one span that may hold a token is the first
    that ends after the token's start, found by binary search."""
    trained = np.array([(a, b) for a, b, on in spans if on and a < b], np.int64).reshape(-1, 2)
    if not len(trained) or not len(starts):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(trained[:, 1], starts, "right")
    inside = at < len(trained)
    at = np.minimum(at, len(trained) - 1)
    return inside & (trained[at, 0] <= starts) & (ends <= trained[at, 1])


def masked_text(rendered: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """The characters covered by masked tokens, each once; bytes of one character share its offsets."""
    starts, ends = starts[loss], ends[loss]
    if not len(starts):
        return ""
    # offsets never go back, so a run ends where the next token starts beyond all ends so far
    reach = np.maximum.accumulate(ends)
    first = np.r_[True, starts[1:] > reach[:-1]]
    last = np.r_[first[1:], True]
    return "".join(rendered[a:b] for a, b in zip(starts[first].tolist(), reach[last].tolist()))


class ChatEncoder:
    """Ids and offsets of rendered conversations; made in the task that uses it."""

    def __init__(self, name: str = BYTE_TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task uses one core
        from tokenizers import AddedToken, Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.add_tokens([AddedToken(mark, normalized=False) for mark in (TURN, TEXT, END)])

    def slices(self, rendered: str) -> list[tuple[int, int]]:
        cuts, at = [0], 0
        while len(rendered) - at > SLICE_CHARS:
            found = _SAFE.search(rendered, at + SLICE_CHARS)
            if found is None:
                break
            at = found.start()
            cuts.append(at)
        return list(zip(cuts, [*cuts[1:], len(rendered)]))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, starts and ends of the tokens of each text, which is encoded once, slice by slice."""
        out = []
        for text in texts:
            ids, spans = [], []
            for a, b in self.slices(text):
                made = self.tokenizer.encode(text[a:b], add_special_tokens=False)
                ids.append(np.array(made.ids, np.int32))
                spans.append(np.array(made.offsets, np.int32).reshape(-1, 2) + a)
            span = np.concatenate(spans)
            out.append((np.concatenate(ids), span[:, 0], span[:, 1]))
        return out


ORDER = ["turn", "code", "tie", "part"]


def _ordered(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", turn_code().alias("code"),
                                F.monotonically_increasing_id().alias("tie"), role.alias("role"), text.alias("text"))
    # the last key tells repeated rows apart, so that even they are spread
    keys = ["conv_id", "turn", "code", "tie"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def turn_code() -> Column:
    """What orders turns of equal number, and tells turns apart: an md5 of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def formatted(conversations: DataFrame, tokenizer: str = BYTE_TOKENIZER) -> DataFrame:
    """Pieces of conversations: conv_id, turn, code, tie, part (their order), open, rendered,
    ids, starts, ends, loss.

    ``open`` is false if the piece is known to be its whole conversation.
    """
    def run(batches):
        encoder = ChatEncoder(tokenizer)
        ready, size = [], 0  # finished pieces that are not encoded yet
        conv = key = None
        turns, chars, part, begun, first = [], 0, 0, False, True

        def flush():
            nonlocal ready, size
            made = encoder.encode([r[3] for r in ready])
            masks = [loss_mask(s, e, r[4]) for r, (_, s, e) in zip(ready, made)]
            offsets = np.cumsum([0, *[len(m) for m in masks]]).astype(np.int32)

            def lists(parts, kind):
                flat = np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in ready], conv_type), pa.array([r[1][0] for r in ready], turn_type),
                 pa.array([r[1][1] for r in ready], pa.string()), pa.array([r[1][2] for r in ready], pa.int64()),
                 pa.array([r[1][3] for r in ready], pa.int32()), pa.array([r[2] for r in ready]),
                 pa.array([r[3] for r in ready], pa.string()), lists([m[0] for m in made], np.int32),
                 lists([m[1] for m in made], np.int32), lists([m[2] for m in made], np.int32), lists(masks, bool)], names)
            ready, size = [], 0
            return out

        def close(is_open):
            nonlocal size
            text, spans = render(turns)
            ready.append((conv, key, is_open, text, spans))
            size += len(text)

        for batch in batches:
            conv_type, turn_type = batch.schema.field("conv_id").type, batch.schema.field("turn").type
            for c, turn, code, tie, role, text in zip(*[batch.column(n).to_pylist() for n in
                                                        ("conv_id", "turn", "code", "tie", "role", "text")]):
                if begun and c != conv:
                    close(first or part > 0)
                    first, turns = False, []
                elif begun and chars + len(role) + len(text) > PIECE_CHARS:
                    close(True)
                    turns, part, chars, key = [], part + 1, 0, (turn, code, tie, part + 1)
                if not begun or c != conv:
                    conv, key, part, chars, begun = c, (turn, code, tie, 0), 0, 0, True
                turns.append((role, text))
                chars += len(role) + len(text)
                if size > BATCH_CHARS:
                    yield flush()
        if begun:
            close(True)  # the next partition may go on with it
            yield flush()

    names = ["conv_id", *ORDER, "open", "rendered", "ids", "starts", "ends", "loss"]
    conv, turn = (conversations.schema[n].dataType.simpleString() for n in ("conv_id", "turn"))
    return _ordered(conversations).mapInArrow(
        run, f"conv_id {conv}, turn {turn}, code string, tie long, part int, open boolean, rendered string, "
             "ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def read_back(pieces: DataFrame) -> DataFrame:
    """What the pieces hold: conv_id, order, open, n_turns, formatted_chars, loss_chars and, as
    digests if the piece is whole and as texts if it is open, turns and loss."""
    def run(batches):
        for batch in batches:
            out = []
            columns = [batch.column(n) for n in ("open", "rendered", "starts", "ends", "loss")]
            for is_open, rendered, starts, ends, loss in zip(*columns):
                rendered = rendered.as_py()
                arrays = [x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, loss)]
                turns = parse(rendered)
                said = unescaped(masked_text(rendered, *arrays))
                lines = "".join(f"{r}\n{t}\n" for r, t in turns)
                if not is_open.as_py():
                    lines, said_out = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, said))
                else:
                    said_out = said
                out.append((len(turns), len(rendered), len(said), lines, said_out))
            values = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("conv_id", *ORDER, "open")] + [pa.array(v, k) for v, k in zip(values, kinds)],
                ["conv_id", *ORDER, "open", "n_turns", "formatted_chars", "loss_chars", "turns", "said"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    head = ", ".join(f"{n} {kinds[n]}" for n in ("conv_id", *ORDER, "open"))
    return pieces.mapInArrow(run, f"{head}, n_turns long, formatted_chars long, loss_chars long, turns string, said string")


def _joined(pieces: DataFrame) -> DataFrame:
    """One row per conversation from its open pieces, streamed in order; a task holds one piece."""
    def run(batches):
        conv, sums, hashes, begun, done = None, None, None, False, []

        def rows():
            columns = list(zip(*done)) or [[]] * 6
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], DIGESTS)

        def close():
            done.append((conv, sums[0], hashes[0].hexdigest(), sums[2], hashes[1].hexdigest(), sums[1]))

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for c, *numbers, turns, said in zip(*[batch.column(n).to_pylist() for n in
                                                  ("conv_id", "n_turns", "formatted_chars", "loss_chars", "turns", "said")]):
                if not begun or c != conv:
                    if begun:
                        close()
                    conv, sums, hashes, begun = c, [0, 0, 0], [hashlib.sha256(), hashlib.sha256()], True
                sums = [a + b for a, b in zip(sums, numbers)]
                hashes[0].update(turns.encode())
                hashes[1].update(said.encode())
            if len(done) > 10_000:
                yield rows()
                done.clear()
        if begun:
            close()
            yield rows()

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return (pieces.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
            .mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def chat_digests(conversations: DataFrame, tokenizer: str = BYTE_TOKENIZER) -> DataFrame:
    """Per conversation, read back from the formatted pieces: the columns ``DIGESTS``.

    Whole pieces are read back in the task that made them. Open ones, at most two per
    partition and those of very long conversations, are shuffled once more; a digest over a
    conversation needs its pieces one after the other, so that stream is one task's work.
    """
    made = cut(read_back(formatted(conversations, tokenizer)), ["open"])
    whole = made.where("not open").select("conv_id", "n_turns", F.col("turns").alias("turns_sha256"), "loss_chars",
                                          F.col("said").alias("loss_sha256"), "formatted_chars")
    return whole.unionAll(_joined(made.where("open")))
