"""Substring dedup by hashing lines and sentences: the earliest occurrence stays, later ones go with their offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A unit: a stretch of one line up to and with its full stop.
UNIT = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W_]+")
#: Units of fewer words are passed over: they recur by chance.
UNIT_WORDS = 3
#: A document loses its repeated units if they have so many words in all. Fewer are what texts rightly share, such as a licence
#: line on its own; a document that repeats more than that loses its short lines too.
SHARED_WORDS = 30
SCHEMA = "doc_id long, m1 long, pos int, start int, end int, words int, d1 long, d2 long"


def units(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit of UNIT_WORDS words or more.

    The digest is of the unit's words in lower case, joined by one space, so spacing, case and punctuation don't matter.
    """
    out = []
    for m in UNIT.finditer(text):
        words = _WORD.findall(m[0])
        if len(words) < UNIT_WORDS:
            continue
        a, b = m.span()
        while text[a].isspace():
            a += 1
        while text[b - 1].isspace():
            b -= 1
        digest = hashlib.blake2b(" ".join(words).lower().encode("utf-8", "surrogatepass"), digest_size=16).digest()
        out.append((a, b, len(words), digest))
    return out


def _units(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
    for rb in it:
        cols: list[list] = [[] for _ in names]
        for i, m1, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2)):
            for pos, (a, b, w, d) in enumerate(units(text.as_py() or "")):
                for c, v in zip(cols, (i, m1, pos, a, b, w, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))):
                    c.append(v)
            if len(cols[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
                cols = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _three(docs: DataFrame) -> list:
    """doc_id, m1 and text of a row; (doc_id, m1) names a document: rows of one id with other texts are others."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("m1"), text.alias("text")]


def _runs(docs: DataFrame, shared_words: int) -> DataFrame:
    each = cut(docs.select(*_three(docs)).mapInArrow(_units, SCHEMA))
    # documents without an id come last, so that what they share with others goes from them
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "m1", "start")
    first = each.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("d1", "d2", "first")
    # written, so its size is known: a small table is broadcast, and a large one joined by a merge whose hot digests AQE splits
    later = each.join(cut(first), ["d1", "d2"]).filter(~place.eqNullSafe(F.col("first"))).drop("d1", "d2")
    later = later.dropDuplicates(["doc_id", "m1", "start", "end"])
    later = later.withColumn("shared", F.sum("words").over(Window.partitionBy("doc_id", "m1"))).filter(F.col("shared") >= shared_words)
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "m1").orderBy("pos", "start"))
    return later.withColumn("run", run).groupBy("doc_id", "m1", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("words").cast("long").alias("n_words"),
        F.min_by("first", "start").alias("first"),
    )


def repeated_passages(docs: DataFrame, shared_words: int = SHARED_WORDS) -> DataFrame:
    """Passages to remove: doc_id, start, end (code points, end exclusive), n_words, first_doc_id, first_start.

    Texts are cut into sentences within lines, each normalised to its lower-cased words and hashed (128 bits). For every
    digest the occurrence that comes first by (doc_id, a digest of the text, start) stays. Later ones go, adjoining ones as one
    run, from every document in which they have shared_words words in all; a document that shares fewer keeps them. first_* is
    where the run's first unit occurred first. A passage without a whole sentence or line in common stays.

    The earliest occurrence is a partially aggregated minimum, and only repeated units are joined and brought together by
    document, so a line that a third of all documents hold costs a row per task before the join, which AQE may split.
    Null and empty texts and texts of short units: no rows. Long texts: whole. Rows that share a doc_id and a text count as
    one document, rows of one doc_id with other texts as others. Documents with a null doc_id come after all others. Empty
    table: empty. Only doc_id and text are read.
    """
    runs = _runs(docs, shared_words)
    return runs.select("doc_id", "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def without_passages(docs: DataFrame, shared_words: int = SHARED_WORDS) -> DataFrame:
    """docs with text less its repeated passages, and removed: the array of (start, end) in the original text.

    A column of docs by the name removed is replaced. Rows that share an id lose what repeats in their own text only.
    """
    spans = F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone")
    gone = _runs(docs, shared_words).groupBy(F.col("doc_id").alias("__id"), F.col("m1").alias("__m")).agg(spans)
    doc_id, m1, text = _three(docs)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), doc_id, m1, text)
    out = own.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("m1") == F.col("__m")), "left")
    out = out.withColumn("gone", F.coalesce("gone", F.array().cast("array<struct<start:int,end:int>>")))
    cutting = F.aggregate(
        "gone",
        F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["t"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"])).alias("t"), x["end"].alias("at")),
        lambda s: F.concat(s["t"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    new = F.when(F.size("gone") > 0, cutting).otherwise(F.col("text"))
    return out.select(*[(new if c == "text" else F.col(f"d.`{c}`")).alias(c) for c in docs.columns if c != "removed"], F.col("gone").alias("removed"))
