"""Conversations as token sequences with a loss mask, assembled from separately encoded segments.

Every turn is a begin marker, its text and an end marker. Markers are ids beyond the vocabulary, spliced in between
segments that are encoded on their own, so no text can make one. Markers also have a written form, the control strings;
where a text holds one, an escape mark is put in, and taken out again when the sequence is read back. The mask follows
from prefix sums over the markers of assistant turns.

A sequence is stored in pieces of whole turns. Rows are dealt by ranges of (conversation, turn), so a conversation that
holds a third of all rows is written by many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.common import chunks, table
from tracetide.llm.tokens import tokenizer_path
from tracetide.session import work_path

TOKENIZER = "byte_bpe_50k.tiktoken"
#: A piece ends with the turn that brings it to this many ids.
PIECE_IDS = 16_384
#: Roles with markers of their own: begin and end. Any other role is written out between `[ROLE]` and `[/ROLE]`.
MARKERS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")
CONTROLS = [*(m for pair in MARKERS.values() for m in pair), *OTHER]
ESCAPE = "\\"

# No control string ends as another begins, so matches cannot overlap.
_ANY = "|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}{{}}{re.escape(c[1:])}" for c in CONTROLS)
_WRITTEN = re.compile(_ANY.replace("{}", "*"))
_ESCAPED = re.compile(_ANY.replace("{}", "+"))


def escaped(text: str) -> str:
    """`text` without control strings: one escape mark more after the first character of each of them.

    Control strings that have escape marks there already get one more as well, which makes the change reversible.
    """
    return _WRITTEN.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescaped(text: str) -> str:
    """The text that `escaped` was given."""
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Codec:
    """Segments to ids and back, by a file of byte-pair ranks; the ids beyond them are the control strings in their order."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pairs = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.base = max(ranks.values()) + 1
        self.marker = {c: self.base + k for k, c in enumerate(CONTROLS)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.pairs.encode_ordinary(t) for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return self.pairs.decode_bytes(ids.tolist()).decode() if len(ids) else ""

    def turn(self, role: str, role_ids: list[int], text_ids: list[int]) -> list[int]:
        """A turn's ids: markers around the encoded segments."""
        if role in MARKERS:
            begin, end = MARKERS[role]
            return [self.marker[begin], *text_ids, self.marker[end]]
        start, named, end = OTHER
        return [self.marker[start], *role_ids, self.marker[named], *text_ids, self.marker[end]]

    def mask(self, ids: np.ndarray) -> np.ndarray:
        """True for the ids of assistant texts: begun and not ended, by prefix sums; markers themselves are left out."""
        begin, end = (ids == self.marker[m] for m in MARKERS["assistant"])
        inside = np.cumsum(begin, dtype=np.int64) - np.cumsum(end, dtype=np.int64)
        return (inside > 0) & ~begin

    def segments(self, ids: np.ndarray) -> Iterator[tuple[str, str, slice]]:
        """(role, text, place of the text's ids) of every turn in `ids`, unescaped."""
        at = np.flatnonzero(ids >= self.base).tolist()
        marks = [CONTROLS[int(ids[k]) - self.base] for k in at]
        begins = {pair[0]: role for role, pair in MARKERS.items()}
        k = 0
        while k < len(at):
            if marks[k] in begins:
                role, first, step = begins[marks[k]], at[k] + 1, 2
            else:
                role, first, step = unescaped(self.decode(ids[at[k] + 1 : at[k + 1]])), at[k + 1] + 1, 3
            place = slice(first, at[k + step - 1])
            yield role, unescaped(self.decode(ids[place])), place
            k += step

    def written(self, ids: np.ndarray) -> str:
        """The formatted text: control strings and escaped segments."""
        at = np.flatnonzero(ids >= self.base).tolist()
        out, begin = [], 0
        for k in at:
            out += [self.decode(ids[begin:k]), CONTROLS[int(ids[k]) - self.base]]
            begin = k + 1
        return "".join([*out, self.decode(ids[begin:])])


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text, read from its control strings alone."""
    begins = {pair[0]: (role, pair[1]) for role, pair in MARKERS.items()}
    out, at = [], 0
    while at < len(text):
        role, end = next((v for b, v in begins.items() if text.startswith(b, at)), (None, OTHER[2]))
        if role is None:
            stop = text.index(OTHER[1], at)
            role, at = unescaped(text[at + len(OTHER[0]) : stop]), stop + len(OTHER[1])
        else:
            at += len(MARKERS[role][0])
        stop = text.index(end, at)
        out.append((role, unescaped(text[at:stop])))
        at = stop + len(end)
    return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each Python worker, kept between tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


@dataclass
class _Piece:
    """Turns of one conversation on their way into a row."""

    conv: int | None
    ids: list[np.ndarray]
    size: int = 0
    turns: int = 0


_COLUMNS = "conv_id long, first_turn long, place long, n_turns int, ids array<int>, loss_mask array<boolean>"


def write_chats(turns: DataFrame, path: str, tokenizer: str | None = None, piece_ids: int = PIECE_IDS) -> None:
    """Format `turns` (conv_id, turn, role, text) and write the sequences as Parquet.

    A row is a piece of a conversation: its place orders the pieces, which hold whole turns and end with the turn that
    brings them to `piece_ids`. Turns go by number, null first, ties by role and text; repeated rows are turns of their
    own. A null text or role is empty, and rows without conv_id make one conversation without id. An empty table makes
    a folder without rows. Columns of other names are not read.
    """
    source = tokenizer or tokenizer_path(TOKENIZER)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, partition = codec(source), TaskContext.get().partitionId()
        open_piece: _Piece | None = None
        first, made, done = None, 0, []

        def close() -> None:
            nonlocal open_piece, made
            ids = np.concatenate(open_piece.ids)
            done.append((open_piece.conv, first, (partition << 40) + made, open_piece.turns, ids, code.mask(ids)))
            open_piece, made = None, made + 1

        def rows() -> pa.RecordBatch:
            conv, turn, place, n, ids, masks = (list(c) for c in zip(*done, strict=True))
            offsets = pa.array([0, *accumulate(map(len, ids))], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), t)) for x, t in ((ids, pa.int32()), (masks, pa.bool_()))]
            done.clear()
            columns = [pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int32()), *lists]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "first_turn", "place", "n_turns", "ids", "loss_mask"])

        for batch in chunks(batches, 3):
            convs, numbers, roles, texts = (c.to_pylist() for c in batch.columns)
            text_ids = code.encode([escaped(t) for t in texts])
            other = dict.fromkeys(r for r in roles if r not in MARKERS)
            role_ids = dict(zip(other, code.encode([escaped(r) for r in other]), strict=True))
            for conv, number, role, ids in zip(convs, numbers, roles, text_ids, strict=True):
                if open_piece is not None and (open_piece.conv != conv or open_piece.size >= piece_ids):
                    close()
                if open_piece is None:
                    open_piece, first = _Piece(conv, []), number
                turn = np.array(code.turn(role, role_ids.get(role, []), ids), dtype=np.int32)
                open_piece.ids.append(turn)
                open_piece.size += len(turn)
                open_piece.turns += 1
            if done:
                yield rows()
        if open_piece is not None:
            close()
            yield rows()

    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    # the hash lets rows with equal numbers go to several tasks
    order = ["conv_id", "turn", "role", "tie", "text"]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order[:4]).sortWithinPartitions(*order).drop("tie")
    rows.mapInArrow(assemble, _COLUMNS).write.option("compression", "zstd").parquet(path)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """The pieces: conv_id, first_turn, place, n_turns, ids, loss_mask. Within a conversation they go by place."""
    return spark.read.schema(_COLUMNS).parquet(path)


def formatted(pieces: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, place, turns, text): each piece as formatted text, with its turns (role, text) read back from the ids."""
    source = tokenizer or tokenizer_path(TOKENIZER)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(source)
        shape = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(2)[k].values.to_numpy()
                turns = [{"role": r, "text": t} for r, t, _ in code.segments(ids)]
                columns = [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([turns], shape), pa.array([code.written(ids)])]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "turns", "text"])

    shape = "conv_id long, place long, turns array<struct<role: string, text: string>>, text string"
    return pieces.select("conv_id", "place", "ids").mapInArrow(read, shape)


class _Digest:
    """What is known of one conversation while its pieces pass."""

    def __init__(self, conv: int | None):
        self.conv, self.n_turns, self.loss_chars, self.formatted_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, code: Codec, ids: np.ndarray, mask: np.ndarray) -> None:
        known = {}
        for role, text, place in code.segments(ids):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            known[place.start, place.stop] = text
        # whatever lies under the mask counts, run by run; a run that is a turn's text has been decoded
        edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()
        for run in zip(edges[::2], edges[1::2], strict=True):
            said = known[run] if run in known else unescaped(code.decode(ids[slice(*run)]))
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.formatted_chars += len(code.written(ids))

    def row(self) -> tuple:
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(pieces: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each conversation, from the stored ids and masks alone.

    A digest is made in one go from first to last byte, so the pieces of a conversation pass through one task, sorted and
    one at a time; nothing of them is kept but the state of two digests.
    """
    source = tokenizer or tokenizer_path(TOKENIZER)
    names = [c.split()[0] for c in _DIGESTS.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, state, done = codec(source), None, []

        def rows() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for k, conv in enumerate(batch.column(0).to_pylist()):
                if state is None or state.conv != conv:
                    if state is not None:
                        done.append(state.row())
                    state = _Digest(conv)
                state.add(code, batch.column(1)[k].values.to_numpy(), batch.column(2)[k].values.to_numpy(zero_copy_only=False))
            if done:
                yield rows()
        if state is not None:
            done.append(state.row())
            yield rows()

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "ids", "loss_mask")
    return dealt.mapInArrow(digest, _DIGESTS)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted, written and read back."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = work_path(spark, "chats")
    write_chats(turns.unionByName(own), path)
    return digests(read_chats(spark, path))
