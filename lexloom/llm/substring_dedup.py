"""Substring dedup: word windows that also start in an earlier document are cut.

Super-k-mer partitioning. Every window of ``k`` words has a minimiser, the
smallest hash among its inner n-grams; equal windows have equal minimisers.
Consecutive windows with one minimiser travel as one packed string to the bucket
of the minimiser, so a word is sent about three times and not ``k`` times. There
the windows are sorted, which brings all occurrences together.

Before the shuffle, each block of documents keeps a packed string only for the
smallest document that has it: for the others the answer is known. So a passage
that a third of all documents share reaches its bucket once per block.

Defined results: null and empty texts have no words and lose none. Rows with a
null doc_id lose nothing and make nobody else lose anything. Rows that repeat a
doc_id count as one document: none is earlier than the other. Columns of the input
that are named like a result's are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .words import HASH, SECOND, Words, blocks, integers, released, released_group

#: Bytes of text that one block packs together, and that one bucket should get.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
#: Windows that are sorted at a time; a larger bucket is sorted in several passes.
PASS_WINDOWS = 1_000_000

#: Columns of a blob's head: doc as differences, as neighbours come from one document or the next.
_HEAD = ("doc", "key", "start", "windows", "bytes")


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries, in a logarithmic number of passes."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _super_kmers(w: Words, h: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each run of windows that share one."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding_min(HASH.grams(h, m), k - m + 1)
    at = np.flatnonzero(w.windows(k)[: len(least)])
    if not len(at):
        return at, at, least[:0]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (w.text[at[1:]] != w.text[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), least[at[first]]


def _pack(k: int, m: int, buckets: int):
    def rows(bucket, blob=None, known=None) -> pa.RecordBatch:
        n = len(bucket)
        both = [pa.nulls(n, pa.binary()) if x is None else pa.array(x, pa.binary()) for x in (blob, known)]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *both], names=["bucket", "blob", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            ids, keys = integers(batch, "doc"), integers(batch, "key")
            for a, b, buf, offsets in blocks(batch, "text", BLOCK_BYTES):
                w = Words(buf, offsets)
                h = w.hashes()
                first, count, least = _super_kmers(w, h, k, m)
                if not len(first):
                    continue
                last = first + count + k - 1
                text = w.text[first]
                doc, key, start = ids[a:b][text], keys[a:b][text], first - w.first[text]
                same = HASH.runs(h, first, last)
                _, group = np.unique(same, return_inverse=True)
                smallest = np.full(group.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(smallest, group, doc)
                later = doc > smallest[group]
                if later.any():
                    known = np.stack([doc[later], key[later], (start[later] << 32) | (count[later] + k - 1)])
                    yield rows([int(same[0] % np.uint64(buckets))], known=[squeeze.compress(known.tobytes())])
                bucket = (least % np.uint64(buckets)).astype(np.int64)
                keep = np.flatnonzero(~later)
                keep = keep[np.argsort(bucket[keep], kind="stable")]
                low, high = w.starts[first[keep]], w.ends[last[keep] - 1]
                head = np.stack([doc[keep], key[keep], start[keep], count[keep], high - low])
                view, low, high = memoryview(buf), low.tolist(), high.tolist()
                cut = np.flatnonzero(np.append(True, np.diff(bucket[keep]) != 0))
                names, made = bucket[keep][cut].tolist(), []
                for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(keep)], strict=True):
                    part = head[:, x:y].copy()
                    part[0, 1:] = np.diff(part[0])
                    made.append(squeeze.compress(b"".join([(y - x).to_bytes(8, "little"), part.tobytes(), *[view[s:e] for s, e in zip(low[x:y], high[x:y], strict=True)]])))
                for x in range(0, len(names), 4096):
                    yield rows(names[x : x + 4096], blob=made[x : x + 4096])

    return released(run)


def _unpack(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    head = dict(zip(_HEAD, np.frombuffer(raw, np.int64, n * len(_HEAD), 8).reshape(len(_HEAD), n), strict=True))
    head["doc"] = np.cumsum(head["doc"])
    return head, np.frombuffer(raw, np.uint8, offset=8 + n * len(_HEAD) * 8), np.append(0, np.cumsum(head["bytes"]))


def _sort_bucket(k: int):
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("span", pa.int64())])

    def spans(table: pa.Table) -> pa.Table:
        packed = [x for x in table.column("blob").to_pylist() if x is not None]
        known = [zstandard.ZstdDecompressor().decompress(x) for x in table.column("known").to_pylist() if x is not None]
        total = sum(int(_unpack(x)[0]["windows"].sum()) for x in packed)
        passes = -(-total // PASS_WINDOWS)
        out = [tuple(np.frombuffer(x, np.int64).reshape(3, -1)) for x in known]
        for turn in range(passes):
            found = []
            for i, blob in enumerate(packed):
                head, buf, offsets = _unpack(blob)
                w = Words(buf, offsets)
                h, h2 = w.hashes(HASH), w.hashes(SECOND)
                at = np.flatnonzero(w.windows(k)) if len(h) >= k else np.zeros(0, np.int64)
                one, two = HASH.grams(h, k)[at], SECOND.grams(h2, k)[at]
                mine = one % np.uint64(passes) == turn
                run = w.text[at]
                found.append((one[mine], two[mine], head["doc"][run[mine]], np.full(mine.sum(), i), run[mine], (at - w.first[run])[mine]))
            one, two, doc, blob_no, run, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            new = np.ones(len(order), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            group = np.cumsum(new) - 1
            smallest = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else doc
            later = np.zeros(len(order), bool)
            later[order] = doc[order] > smallest[group] if len(order) else False
            hit = np.flatnonzero(later)  # still in the order of blob, run and place
            if not len(hit):
                continue
            begin = np.ones(len(hit), bool)
            begin[1:] = (np.diff(blob_no[hit]) != 0) | (np.diff(run[hit]) != 0) | (np.diff(place[hit]) != 1)
            cut = np.flatnonzero(begin)
            size = np.diff(np.append(cut, len(hit)))
            cut = hit[cut]
            for i in np.unique(blob_no[cut]).tolist():
                mine = blob_no[cut] == i
                head, at = _unpack(packed[i])[0], run[cut[mine]]
                out.append((head["doc"][at], head["key"][at], ((head["start"][at] + place[cut[mine]]) << 32) | (size[mine] + k - 1)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(columns, schema=schema)

    return spans


def _cut(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            spans = batch.column(batch.schema.get_field_index("spans"))
            lengths = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).tolist()
            values, at = spans.flatten().to_numpy(zero_copy_only=False), 0
            kept, words, removed = [], [0] * n, [0] * n
            for i, (text, many) in enumerate(zip(texts, lengths, strict=True)):
                found = (text or "").encode().split()
                words[i] = len(found)
                if many:
                    mine = values[at : at + many]
                    at += many
                    edge = np.zeros(len(found) + 1, np.int64)
                    np.add.at(edge, mine >> 32, 1)
                    np.add.at(edge, (mine >> 32) + (mine & 0xFFFFFFFF), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    removed[i] = len(found) - int(stay.sum())
                    found = [x for x, y in zip(found, stay.tolist(), strict=True) if y]
                kept.append(b" ".join(found).decode())
            made = {"kept_text": pa.array(kept, pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), *made.values()], names=[*columns, *made])

    return released(run)


def remove_repeated_passages(docs: DataFrame, k: int = 13, minimiser_words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Columns of ``docs`` and ``kept_text`` (kept words, one space between), ``n_words``, ``n_removed``."""
    docs = docs.drop("kept_text", "n_words", "n_removed")
    # Only where a doc_id repeats must its rows be told apart, by their texts.
    repeats = docs.groupBy(F.col(doc_id).cast("long").alias("doc")).count().where("count > 1 and doc is not null")
    key = F.lit(0).cast("long") if repeats.isEmpty() else F.xxhash64(text)
    own = docs.select(F.col(doc_id).cast("long").alias("doc"), key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, size // BUCKET_BYTES)
    sent = own.where("doc is not null").mapInArrow(_pack(k, minimiser_words, buckets), "bucket long, blob binary, known binary")
    spans = sent.groupBy("bucket").applyInArrow(released_group(_sort_bucket(k)), "doc long, key long, span long")
    spans = spans.groupBy("doc", "key").agg(F.collect_list("span").alias("spans"))
    extra = [c for c in docs.columns if c not in (doc_id, text)]
    rows = docs.select(F.col(doc_id).alias("doc"), key.alias("key"), F.col(text).alias("text"), F.col(doc_id).alias("id_as_given"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)])
    rows = rows.withColumn("doc", F.col("doc").cast("long"))
    joined = rows.join(spans, ["doc", "key"], "left").drop("doc", "key")
    keep = ["id_as_given", "text", *[f"x{i}" for i in range(len(extra))]]
    kinds = dict(joined.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", kept_text string, n_words long, n_removed long"
    done = joined.select(*keep, "spans").mapInArrow(_cut(keep), schema)
    back = {doc_id: "id_as_given", text: "text"} | {c: f"x{i}" for i, c in enumerate(extra)}
    return done.select(*[F.col(back[c]).alias(c) for c in docs.columns], "kept_text", "n_words", "n_removed")


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = remove_repeated_passages(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)
), least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s
), hit AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (s) WHERE doc_id > m)
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d
), kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS text
  FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id AND words.p = hit.p WHERE hit.p IS NULL GROUP BY words.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
