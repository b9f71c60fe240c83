"""Language identification by compression.

Each language has a raw-content zstandard dictionary, made of pieces from anywhere in
the whole texts of a bounded sample. Case is folded. A text is cut into pieces of ``PIECE`` bytes (all of it, to its end), each
piece is encoded with each dictionary, and the language of the smallest total
wins. ``score`` is the margin to the second smallest, as 0.5 to 1 by the bytes
saved for each byte of text. A margin under ``min_margin`` rejects: ``rejected``
is true and, for a caller that asks for it, the language becomes ``und``.

Defined results: null texts and texts without a letter are ``und`` with score 0.
Rows with a null lang teach nothing. More than ``MAX_LANGUAGES`` languages are an error. Without any training text all is ``und``.
Ties go to the language first in code-point order. No row is dropped. Columns of
the input that are named like a result's are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .quality import crc_class
from .words import released

#: Texts sampled for each language, pieces taken of each and their bytes, languages at most.
SAMPLE_TEXTS, SAMPLE_PIECES, PIECE_BYTES, MAX_LANGUAGES = 512, 4, 128, 512
PIECE, LEVEL = 1024, 6


def _pieces(pieces: int, size: int) -> Column:
    """Of the bytes ``raw``: one piece from a hash-chosen place of each of so many equal parts, all of it where that is no more."""
    part = F.floor(F.octet_length("raw") / pieces).cast("int")
    place = [F.pmod(F.xxhash64(F.lit(f"piece {k}"), "order"), part - size + 1).cast("int") for k in range(pieces)]
    cut = F.array(*[F.col("raw").substr(part * k + at + 1, F.lit(size)) for k, at in enumerate(place)])
    return F.when(F.octet_length("raw") <= pieces * size, F.array("raw")).otherwise(cut)


def train_dictionaries(docs: DataFrame, learn_from: Column | None = None, sample_texts: int = SAMPLE_TEXTS, sample_pieces: int = SAMPLE_PIECES, piece_bytes: int = PIECE_BYTES) -> dict[str, bytes]:
    """One dictionary for each language, of at most ``sample_texts`` texts.

    Of each text there are ``sample_pieces`` pieces of ``piece_bytes`` bytes from
    hash-chosen places of the whole text, one in each of so many equal parts; a text of
    no more bytes is taken whole. So a language has at most sample_texts *
    sample_pieces * piece_bytes bytes (256 KiB by default). A ValueError tells of more
    than ``MAX_LANGUAGES`` languages.
    """
    known = docs.where("doc_id is not null and text is not null and lang is not null")
    if learn_from is not None:
        known = known.where(learn_from)
    if known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages (MAX_LANGUAGES) to learn")
    # The row of the smallest hash in each hash class: partial aggregates, no sort of a language's rows.
    classes = known.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(sample_texts)).alias("class"))
    chosen = classes.agg(F.min(F.struct(F.xxhash64(F.lit("order"), "doc_id").alias("order"), "doc_id")).alias("x"))
    texts = known.join(F.broadcast(chosen.select("lang", "x.doc_id", "x.order")), ["lang", "doc_id"])
    texts = texts.select("lang", "order", F.encode(F.lower("text"), "utf-8").alias("raw"))
    texts = texts.select("lang", "order", F.posexplode(_pieces(sample_pieces, piece_bytes)).alias("place", "piece"))
    rows = texts.groupBy("lang").agg(F.sort_array(F.collect_set(F.struct("order", "place", "piece"))).alias("pieces")).toPandas()
    return {r.lang: b"\n".join(bytes(x["piece"]) for x in r.pieces) for r in rows.sort_values("lang").itertuples()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.0, reject_as_und: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` and ``rejected``."""
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    sent = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, packers = [], []
        for lang, raw in sent.value:
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            langs.append(lang)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            best, score, narrow = [], [], []
            for value in batch.column(len(names)):
                if not value.is_valid or not langs:
                    best.append("und"), score.append(0.0), narrow.append(True)
                    continue
                raw = memoryview(value.as_buffer())
                pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
                sizes = np.array([sum(len(p.compress(x)) for x in pieces) for p in packers])
                order = np.argsort(sizes, kind="stable")
                margin = (sizes[order[1]] - sizes[order[0]]) / len(raw) if len(order) > 1 else 1.0
                rejected = bool(margin < min_margin)
                best.append("und" if rejected and reject_as_und else langs[order[0]])
                score.append(float(1.0 - 0.5 * np.exp(-20.0 * margin)))
                narrow.append(rejected)
            made = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    plain = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)], F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")).alias("lowered"))
    schema = ", ".join(f"{c} {kind}" for c, kind in plain.dtypes[:-1]) + ", lang_pred string, score double, rejected boolean"
    made = plain.mapInArrow(released(run), schema)
    return made.select(*[F.col(i).alias(c) for c, i in zip(names, inner, strict=True)], "lang_pred", "score", "rejected")


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    dictionaries = train_dictionaries(docs, learn_from=crc_class(4) != 2)
    found = identify(docs.select("doc_id", "text"), dictionaries, min_margin=0.002)
    return found.select("doc_id", F.coalesce(crc_class(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
