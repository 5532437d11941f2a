"""Fill-in-middle transformation by secondary sort.

A text is cut into pieces of a bounded number of code points, keyed by document and by their
place in the output.  Rows are dealt out by document and sorted within partitions by place, so
a document's output passes as a stream, piece by piece, into a running digest, however long it
is: ``repartition`` and ``sortWithinPartitions`` are the DataFrame's form of
``repartitionAndSortWithinPartitions``.  The pieces of an output, read in their order, say by
the marks before them which section they belong to; sorted again by section they give the
text back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Marks before the prefix, the suffix and the middle, and the order of sections in a text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SECTIONS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Order of sections in the output by form.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Per cent of texts that are transformed, and of those that start with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Code points of a piece, and of the pieces that a task sends on at once.
UNIT, BATCH = 16_384, 1 << 20

ABOUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint"
PIECES = f"doc_key binary, doc_id bigint, place bigint, mark string, piece string, digest string, {ABOUT}"
DIGESTS = f"doc_key binary, doc_id bigint, {ABOUT}, copies bigint, digest string, sha256 string"
#: Position of the piece in a row of pieces, and of what is said about the document.
PIECE, FIRST_ABOUT = 4, 6


def draws(doc_id: int | None) -> tuple[int, ...]:
    """Four numbers below 2**32 that the document's id decides; NULL counts as the empty id."""
    code = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).digest()
    return tuple(int.from_bytes(code[i:i + 4], "big") for i in range(0, 16, 4))


def plan(doc_id: int | None, text: str) -> tuple[str, int, int]:
    """Form of the output, and where prefix and middle end."""
    n = len(text)
    one, two, chance, order = draws(doc_id)
    if not text or chance % 100 >= TRANSFORMED or any(mark in text for mark in SECTIONS):
        return "plain", n, n
    start, end = sorted((one % (n + 1), two % (n + 1)))
    return ("spm" if order % 100 < SUFFIX_FIRST else "psm"), start, end


def stream(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str, piece: int | None = None) -> DataFrame:
    """Rows that ``fn`` makes of each partition's rows in their order.  A batch is sent on when
    its pieces (values at ``piece``) hold ``BATCH`` characters, so few are held at a time."""
    schema = T.StructType.fromDDL(ddl)
    layout = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), layout)], schema=layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for start in range(0, b.num_rows, 64)
                for row in zip(*(c.to_pylist() for c in b.slice(start, 64).columns)))
        held, size = [], 0
        for row in fn(rows):
            held.append(row)
            size += 100 + (len(row[piece]) if piece is not None else 0)
            if size >= BATCH:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return df.mapInArrow(run, schema)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """The outputs of whole texts as pieces of at most ``unit`` code points, in no order.

    ``place`` is a piece's offset in the output's text, marks aside, doubled so that a section
    without characters keeps a place of its own before the next.  ``mark`` is the mark that
    stands before the piece, NULL within a section and in plain outputs.  NULL texts are empty;
    an empty text is one empty plain piece.  NULL ids decide as the empty id.  ``doc_key``
    tells rows apart, except equal ones that one task read: those are repeated pieces, which
    the digests count as copies.  Other columns of ``docs`` are left out."""
    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        for doc_id, text in rows:
            key = hashlib.md5(b"%d|%a|" % (part, doc_id) + text.encode()).digest()
            form, start, end = plan(doc_id, text)
            spans = {PREFIX: (0, start), MIDDLE: (start, end), SUFFIX: (end, len(text))}
            about = (len(text), form, *((None, None) if form == "plain" else (start, end - start)))
            place = 0
            for mark in ORDERS.get(form, (PREFIX,)):
                first, last = spans[mark]
                for at in range(first, max(last, first + 1), unit):
                    piece = text[at:min(at + unit, last)]
                    lead = mark if at == first and form != "plain" else None
                    yield key, doc_id, place, lead, piece, None, *about
                    place += 2 * len(piece) or 1

    text = F.coalesce(F.col(text_col), F.lit(""))
    return stream(docs.select(F.col(id_col).cast("bigint"), text), cut, PIECES, PIECE)


def in_output_order(cut: DataFrame) -> DataFrame:
    """Pieces dealt out by document and sorted by place within partitions."""
    return cut.repartition("doc_key").sortWithinPartitions("doc_key", "place")


def documents(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple[tuple, int]]]]:
    """Documents of a sorted stream of pieces: the first row, and all rows in order with their
    number of copies (equal places of one document)."""
    for _, own in groupby(rows, itemgetter(0)):
        first = next(own)

        def places() -> Iterator[tuple[tuple, int]]:
            row, copies = first, 1
            for other in own:
                if other[2] == row[2]:
                    copies += 1
                else:
                    yield row, copies
                    row, copies = other, 1
            yield row, copies

        yield first, places()


def in_text_order(ordered: DataFrame) -> DataFrame:
    """Pieces given in output order, sorted into the order of the text within the partitions
    they are in.  The marks alone say where a piece belongs, and are taken off.  A closing row
    without text carries the digest of the output as it passed, once per copy of the document."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for first, places in documents(rows):
            output, section, count, copies = hashlib.sha256(), 0, 0, 1
            for row, copies in places:
                mark, piece = row[3], row[PIECE]
                output.update(((mark or "") + piece).encode())
                section = SECTIONS[mark] if mark else section
                count += 1
                yield *first[:2], section << 48 | count, None, piece, None, *first[FIRST_ABOUT:]
            closing = (*first[:2], len(SECTIONS) << 48, None, "", output.hexdigest(), *first[FIRST_ABOUT:])
            yield from (closing for _ in range(copies))

    return stream(ordered, run, PIECES, PIECE).sortWithinPartitions("doc_key", "place")


def digests(ordered: DataFrame) -> DataFrame:
    """One row per document: SHA-256 of its marks and pieces as they pass, the digest that a
    closing row carries (else NULL), and ``copies``."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for first, places in documents(rows):
            digest, carried, copies = hashlib.sha256(), None, 1
            for row, copies in places:
                digest.update(((row[3] or "") + row[PIECE]).encode())
                carried = row[5] or carried
            yield *first[:2], *first[FIRST_ABOUT:], copies, carried, digest.hexdigest()

    return stream(ordered, run, DIGESTS)


def texts(ordered: DataFrame) -> DataFrame:
    """One row per document with the whole ``text`` that its sorted pieces make, be they an
    output or a text restored from one; equal rows are all kept."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for first, places in documents(rows):
            passed = [((row[3] or "") + row[PIECE], copies) for row, copies in places]
            text, copies = "".join(p for p, _ in passed), passed[-1][1]
            yield from ((first[1], *first[FIRST_ABOUT:], text) for _ in range(copies))

    return stream(ordered, run, f"doc_id bigint, {ABOUT}, text string", 5)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """One row per document with form and lengths, ``output_sha256`` and ``restored_sha256``,
    the digest of the text rebuilt from the output.  An empty table gives no rows; equal rows
    are all kept.  Pieces are shuffled once: sorted for the output, read, and sorted again."""
    found = digests(in_text_order(in_output_order(pieces(docs, id_col, text_col, unit))))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return found.withColumn("copies", copies).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("digest").alias("output_sha256"), F.col("sha256").alias("restored_sha256"))
