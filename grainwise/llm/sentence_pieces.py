"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker after another character, and few
characters ever stand side by side in a piece.  A text falls apart where neither can happen,
and what a chunk becomes does not depend on its neighbours.  So the chunks of all texts are
counted, the frequent ones segmented once and sent to every task as a table; a task adds each
other chunk that it meets, once, and puts the ids in the chunks' places.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import keep, map_rows

#: Public vocabulary.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A private-use character; it is in no piece, so nothing joins with it.
WALL = "\ue000"
#: What an unsuitable model (one that changes texts) does not give back.
PROBE = "  ﬁ Ａ x  "
#: Chunks looked up where texts lie, the characters of one and of all of them at most.
HEAD, LONGEST, HEAD_CHARS = 150_000, 4096, 16 << 20
#: Chunks a task counts at once, and those it adds to the table before it starts anew.
COUNTED, ADDED = 250_000, 150_000
#: Chunks are classed by 8 * log2 of their counts, to find the frequent ones.
CLASSES_PER_BIT = 8


@dataclass
class Vocabulary:
    """A model as bytes, sent with the tasks, and the pattern that cuts marked texts."""

    model: bytes
    pattern: str
    size: int

    @cached_property
    def processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("model", "pattern", "size")}

    @property
    def packed(self) -> np.dtype:
        return np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    @cached_property
    def wall(self) -> int:
        return len(self.processor.encode(WALL))

    def pack(self, chunk: str) -> bytes:
        """Ids of one chunk, taken behind a wall so that no marker is put before it."""
        return np.array(self.processor.encode(WALL + chunk)[self.wall:], self.packed).tobytes()

    def cutter(self):
        """A function from a text to its chunks; an empty text has none."""
        find = re.compile(self.pattern, re.S).findall
        return lambda text: find(MARK + text.replace(" ", MARK)) if text else []


def neighbours(pieces: list[str]) -> list[str]:
    """Characters grouped so that any two side by side in a piece share a group; markers aside."""
    group: dict[str, set[str]] = {}
    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            if MARK not in (a, b) and (one := group.setdefault(a, {a})) is not (other := group.setdefault(b, {b})):
                small, large = sorted((one, other), key=len)
                large |= small
                group.update(dict.fromkeys(small, large))
    return sorted("".join(sorted(g)) for g in {id(g): g for g in group.values()}.values())


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """The model of a file, read where the job is built.  Refused are models that change texts
    before they cut them, that know no bytes, or whose pieces cross a whitespace marker."""
    with open(path, "rb") as file:
        vocabulary = Vocabulary(file.read(), "", 0)
    processor = vocabulary.processor
    vocabulary.size = processor.get_piece_size()
    known = [i for i in range(vocabulary.size) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
    pieces = [processor.id_to_piece(i) for i in known]
    if sum(processor.is_byte(i) for i in range(vocabulary.size)) != 256 or processor.decode(processor.encode(PROBE)) != PROBE:
        raise ValueError("the model must keep texts as they are and fall back to bytes")
    if any(MARK in p.lstrip(MARK) or WALL in p for p in pieces):
        raise ValueError("pieces of the model cross whitespace markers")
    runs = "|".join(f"[{re.escape(g)}]+" for g in neighbours(pieces))
    word = f"(?:{runs}|[^{MARK}])" if runs else f"[^{MARK}]"
    vocabulary.pattern = f"{MARK}+{word}?|{word}"
    return vocabulary


def chunk_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """Every distinct chunk of the texts with ``n``, how often it occurs, counted in tasks
    before it is shuffled."""
    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        cut, counts = vocabulary.cutter(), Counter()
        for text, in rows:
            counts.update(cut(text))
            if len(counts) > COUNTED:
                yield from counts.items()
                counts = Counter()
        yield from counts.items()

    counted = map_rows(docs.select(F.coalesce(text_col, F.lit(""))), count, "chunk string, n bigint")
    return keep(counted.groupBy("chunk").agg(F.sum("n").alias("n")))


def frequent(counts: DataFrame, limit: int = HEAD) -> DataFrame:
    """The most frequent of the counted chunks, ``limit`` chunks and ``HEAD_CHARS`` characters
    at most.  Classes of counts say how far down they reach."""
    level = F.floor(F.log2("n") * CLASSES_PER_BIT).cast("int")
    short = F.length("chunk") <= LONGEST
    sizes = counts.where(short).groupBy(level.alias("level")).agg(F.count(F.lit(1)), F.sum(F.length("chunk")))
    room, chars, lowest = limit, HEAD_CHARS, None
    for reached, n, length in sorted(sizes.collect(), reverse=True):
        room, chars = room - n, chars - length
        if min(room, chars) < 0:
            break
        lowest = reached
    return counts.where(F.lit(False) if lowest is None else short & (level >= lowest))


def segment_all(chunks: DataFrame, vocabulary: Vocabulary) -> dict[str, bytes]:
    """The packed ids of chunks of bounded number and size."""
    def segment(rows: Iterator[tuple]) -> Iterator[tuple]:
        return ((chunk, vocabulary.pack(chunk)) for chunk, in rows)

    rows = map_rows(chunks.select("chunk"), segment, "chunk string, ids binary").toPandas()
    return dict(zip(rows["chunk"], map(bytes, rows["ids"])))


class ChunkTable(dict):
    """Packed ids by chunk; a chunk that is not in the table is segmented and added."""

    def __init__(self, known: dict[str, bytes], vocabulary: Vocabulary):
        super().__init__(known)
        self.pack, self.bound = vocabulary.pack, len(known) + ADDED

    def __missing__(self, chunk: str) -> bytes:
        ids = self.pack(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``docs`` with ``ids`` (array of int), the pieces of the whole text as the library gives
    them, without begin and end.  A column of that name is replaced.  NULL and empty texts have
    no ids; an empty table stays empty; repeated rows are all kept.

    At most ``head`` frequent chunks are segmented once for all texts; of the others, a task
    holds at most ``ADDED`` at a time.  Texts and their ids are never shuffled."""
    known = segment_all(frequent(chunk_counts(docs, vocabulary, text_col), head), vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("array<int>")
    def look_up(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut, table = vocabulary.cutter(), ChunkTable(sent.value, vocabulary)
        for texts in parts:
            packed = []
            for text in texts:
                if len(table) > table.bound:
                    table = ChunkTable(sent.value, vocabulary)
                packed.append(b"".join(map(table.__getitem__, cut(text.as_py()))))
            ends = np.cumsum([0, *map(len, packed)]) // vocabulary.packed.itemsize
            ids = np.frombuffer(b"".join(packed), vocabulary.packed).astype(np.int32)
            yield pa.ListArray.from_arrays(ends.astype(np.int32), ids)

    return docs.drop("ids").withColumn("ids", look_up(F.coalesce(F.col(text_col), F.lit(""))))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for, as the library puts it together.  NULL
    and empty ids give an empty text; a column of that name is replaced."""
    @F.arrow_udf("string")
    def text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = vocabulary.processor.decode
        for rows in parts:
            yield pa.array((decode(ids.values.to_numpy().tolist()) if len(ids) else "" for ids in rows), pa.string())

    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return encoded.drop(text_col).withColumn(text_col, text(ids))
