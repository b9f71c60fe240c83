"""Cross-tokenizer alignment: groups of tokens of two tokenizers that end together, and their links.

Relational: tokens are exploded with their positions, cumulative lengths over a window
give each token's end, rows of both tokenizers with the same text and end meet, a
running count of those cuts numbers the groups, and the tokens of a number are a group.
The meeting is the equi-join on text and end as a merge: rows of both sides, dealt by
text, stand next to each other in a window ordered by end, so it needs no further shuffle.

The texts that go through this are the corpus's distinct *pieces*. Neither tokenizer
has a token that crosses from a printable character to a following space, so both cut
there, a text's tokens are its pieces' tokens in order, and no group crosses a piece.
``separable`` reads that property off the two files; where it doesn't hold, a piece is
a whole text. So the tokenizers and the token rows cost as much as the distinct pieces,
and counts of the corpus are sums over pieces times how often they occur.
A document's digest and sums are put together from the records of its pieces (see
``pieces``).

Texts of which a tokenizer gives other bytes than they have are found by their pieces;
they have no tokens and their occurrences are taken out of the counts.

Defined results: null and empty texts have no tokens: zeros and an empty digest. Ties
for the highest count of a B id all count as best. Repeated rows are counted each and
returned each. An empty table gives an empty one. Texts are encoded whole, however
long; a text of many megabytes without any space is one piece, in one task. Further
columns of the input pass through; of those named like a result's, the result's stay.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import arrow_udf

from . import pieces
from .scratch import discard, groups_in_order, written
from .words import release

#: Before a space with something behind it, after a character that no white space class has. The space before the text is the prefix.
CUT = "(?= [\\s\\S])(?<=[!-~¡-ᙿ、-퟿])"
_BEFORE = re.compile("[!-~¡-ᙿ、-퟿]")
#: Nowhere: a piece is a whole text.
NO_CUT = "(?!)"
#: Characters that are encoded in one go.
RUN_CHARS = 4096
#: Pairs whose counts are sent to all tasks; more are joined by shuffle.
BROADCAST_PAIRS = 1 << 19
#: Token rows are dealt into so many times the session's shuffle partitions.
SHARES = 2
NUMBERS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")
_TOKENS = "same boolean, n_a int, ids array<int>, sizes array<int>"


class Pair:
    """The two tokenizers and the bytes of their tokens, from their files' contents."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it has
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        # Byte-level characters: printable bytes stand for themselves, the others for 256 and following.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in plain]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes = [bytes([int(x[3:-1], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int32) for y in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Ids of texts that begin with a space; B adds it itself."""
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([x[1:] for x in texts], num_threads=1)

    def encode_pieces(self, texts: list[str]) -> tuple[list, list, list[bool]]:
        """Ids of pieces, and whether they have the piece's bytes: those that a space may follow are encoded some hundreds at a time, and cut apart by their lengths."""
        a: list = [None] * len(texts)
        b: list = [None] * len(texts)
        same = [True] * len(texts)
        runs, own, size = [], [], 0
        for i in (i for i, x in enumerate(texts) if x[-1:] and _BEFORE.match(x[-1])):
            own.append(i)
            size += len(texts[i])
            if size >= RUN_CHARS:
                runs.append(own)
                own, size = [], 0
        runs += [own] * bool(own)
        joined = ["".join([texts[i] for i in x]) for x in runs]
        for own, text, x, y in zip(runs, joined, *self.encode(joined), strict=True):
            ends = np.cumsum([len(texts[i].encode()) for i in own])
            at = [np.searchsorted(np.cumsum(sizes[ids]), ends, side="right") for sizes, ids in ((self.a_sizes, x), (self.b_sizes, y))]
            if self.same(text, x, y):
                for made, ids, to in ((a, x, at[0].tolist()), (b, y, at[1].tolist())):
                    for i, low, high in zip(own, [0, *to], to):
                        made[i] = ids[low:high]
        rest = [i for i, x in enumerate(a) if x is None]
        for i, x, y in zip(rest, *self.encode([texts[i] for i in rest]), strict=True):
            a[i], b[i], same[i] = x, y, self.same(texts[i], x, y)
        return a, b, same

    def same(self, text: str, a: list[int], b: list[int]) -> bool:
        return b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]) == text.encode()


def separable(a: bytes, b: bytes) -> bool:
    """Whether both tokenizers cut wherever ``CUT`` does, as their files say."""
    spec = json.loads(a)
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
        return False
    own = Pair(a, b)
    if any("▁" in x.lstrip("▁") for x in (own.b.id_to_piece(i) for i in range(own.b.get_piece_size()))):
        return False
    sample = "x  y. z "  # neither the spaces nor the prefix may be normalised away
    return b"".join(own.b_bytes[i] for i in own.b.encode(sample)) == f" {sample}".encode()


def _tokens(content: tuple[bytes, bytes], cut: str):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Pair(*content)
        for column in columns:
            texts = column.to_pylist()
            if cut == NO_CUT:
                a, b = own.encode(texts)
                same = list(map(own.same, texts, a, b))
            else:
                a, b, same = own.encode_pieces(texts)
            both = [x for pair in zip(a, b, strict=True) for x in pair]
            counts = np.fromiter(map(len, both), np.int64, len(both))
            ids = np.fromiter((i for x in both for i in x), np.int32, counts.sum())
            of_a = np.repeat(np.arange(len(both)) % 2 == 0, counts)
            size = np.where(of_a, own.a_sizes[np.where(of_a, ids, 0)], own.b_sizes[np.where(of_a, 0, ids)])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts.reshape(-1, 2).sum(axis=1))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, size)]
            yield pa.StructArray.from_arrays([pa.array(same, pa.bool_()), pa.array(counts[::2], pa.int32()), *lists], names=["same", "n_a", "ids", "sizes"])
        del own
        release()  # the worker lives on, without the tokenizers

    return arrow_udf(run, _TOKENS)


def aligned(counted: DataFrame, content: tuple[bytes, bytes], cut: str = NO_CUT) -> DataFrame:
    """For each text (piece, n): same, n_a, n_b, n_groups, groups (``a1,a2|b1;...``) and links, the (a, b) that end together.

    piece must be distinct; cut: the pattern by which they were cut. Where same is false, both tokenizers' bytes aren't the text's.
    """
    key = ["piece", "n", "same"]
    encoded = counted.withColumn("t", _tokens(content, cut)("piece")).select("piece", "n", "t.*")
    # Dealt by piece once; all windows and groups below keep that. An inner explode would put its filter, and so the tokenizers, before the counting.
    # A piece has many times its size in token rows, and a task sorts its share of them twice: so there are more shares than elsewhere.
    shares = SHARES * int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = encoded.repartition(shares, "piece").select(*key, "n_a", F.posexplode_outer(F.arrays_zip("ids", "sizes")).alias("place", "t"))
    rows = rows.select(*key, (F.col("place") >= F.col("n_a")).cast("int").alias("side"), "place", F.col("t.ids").alias("token"), F.col("t.sizes").alias("size"))
    ends = rows.withColumn("end", F.sum("size").over(Window.partitionBy("piece", "side").orderBy("place")))
    # A's row stands before B's with the same end: the two of a cut are neighbours.
    met = Window.partitionBy("piece").orderBy("end", "side")
    cuts = ends.withColumn("other", F.when((F.lag("end").over(met) == F.col("end")) & (F.col("side") == 1), F.lag("token").over(met)))
    number = F.count("other").over(met.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("other").isNotNull().cast("long")
    numbered = cuts.withColumn("number", number)
    token = F.struct("number", "side", "end", "token")
    # By the piece alone: that is the order in which the windows leave the rows (see ``groups_in_order``).
    whole = numbered.groupBy("piece").agg(
        F.first("n").alias("n"),
        F.first("same").alias("same"),
        F.coalesce(F.sum(1 - F.col("side")), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("side"), F.lit(0)).alias("n_b"),
        F.count("other").alias("n_groups"),
        F.sort_array(F.collect_list(token)).alias("tokens"),
        F.collect_list(F.when(F.col("other").isNotNull(), F.struct(F.col("other").alias("a"), F.col("token").alias("b")))).alias("links"),
    )

    def written_out(x, i):
        before = F.col("tokens")[i - 1]
        mark = F.when(i == 0, "").when(before["number"] != x["number"], ";").when(before["side"] != x["side"], "|").otherwise(",")
        return F.concat(mark, x["token"].cast("string"))

    return whole.select(*key, "n_a", "n_b", "n_groups", F.concat_ws("", F.transform("tokens", written_out)).alias("groups"), "links")


def pair_counts(records: DataFrame) -> DataFrame:
    """a, b, count (links of the corpus that hold the pair) and best (whether that is b's highest)."""
    pairs = records.select("n", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("n").alias("count"))
    pairs = written(pairs.where("count > 0"), "pairs")
    best = pairs.groupBy(F.col("b").alias("best_b_")).agg(F.max("count").alias("most_"))
    # One row for each id of B's vocabulary at most.
    return pairs.join(F.broadcast(best), F.col("b") == F.col("best_b_")).select("a", "b", "count", (F.col("count") == F.col("most_")).cast("long").alias("best"))


def _without_odd_texts(records: DataFrame, texts: DataFrame, cut: str) -> DataFrame:
    """The records with the occurrences in texts that hold a piece of other bytes taken out of n."""
    odd = records.where(~F.col("same")).select("piece")
    if odd.isEmpty():
        return records
    key = F.struct(F.xxhash64("text"), F.octet_length("text")).alias("key")
    split = pieces.pieces_of(F.concat(F.lit(" "), "text"), cut)
    holders = texts.select(key, F.explode(split).alias("piece")).join(odd, "piece", "left_semi").select("key").distinct()
    odd_texts = texts.select("text", key).join(holders, "key", "left_semi")
    lost = pieces.counted(odd_texts, split).select(F.col("piece").alias("lost_piece_"), F.col("n").alias("lost_"))
    left = records.join(lost, F.col("piece") == F.col("lost_piece_"), "left")
    return left.withColumn("n", F.col("n") - F.coalesce("lost_", F.lit(0))).drop("lost_piece_", "lost_")


def _scored(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """The records with n_best and count_sum of their links in place of the links."""
    pairs = pairs.select(F.col("a").alias("pair_a_"), F.col("b").alias("pair_b_"), "count", "best")
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    key = ["piece", "n", "same", "n_a", "n_b", "n_groups", "groups"]
    links = records.select(*key, F.explode_outer("links").alias("l"))
    joined = links.join(pairs, (F.col("l.a") == F.col("pair_a_")) & (F.col("l.b") == F.col("pair_b_")), "left")
    return joined.groupBy(*key).agg(F.coalesce(F.sum("best"), F.lit(0)).alias("n_best"), F.coalesce(F.sum("count"), F.lit(0)).alias("count_sum"))


def alignments(docs: DataFrame, a_path: str, b_path: str, frequent: int | None = None) -> DataFrame:
    """Columns of ``docs`` but text, and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    content = (Path(a_path).read_bytes(), Path(b_path).read_bytes())  # on the driver; the tasks get the bytes
    cut = CUT if separable(*content) else NO_CUT
    docs = docs.drop(*NUMBERS, "n_links", "groups_sha256")
    texts = docs.select("text").where(F.octet_length("text") > 0)
    with groups_in_order(spark):
        made = written(aligned(pieces.counted(texts, pieces.pieces_of(F.concat(F.lit(" "), "text"), cut)), content, cut), "aligned-pieces")
    records = _without_odd_texts(made, texts, cut)
    records = written(_scored(records, pair_counts(records)), "piece-records")
    discard(made)
    most, others = pieces.parted(records, frequent)
    sent = spark.sparkContext.broadcast(pieces.Dictionary(most))
    keep = tuple(c for c in docs.columns if c != "text")
    rows = pieces.coded(docs.withColumn("text", F.when(F.octet_length("text") > 0, F.col("text"))), cut, " ", sent, keep, "coded-texts")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        size, groups = own.size, own.column("groups").to_pylist()
        numbers = np.stack([own.column(c).to_numpy() for c in NUMBERS])
        odd = ~own.column("same").to_numpy(zero_copy_only=False)
        for batch in batches:
            totals, digests = np.zeros((batch.num_rows, len(NUMBERS)), np.int64), [""] * batch.num_rows
            rare = batch.column(batch.num_columns - 1)
            bounds, values = rare.offsets.to_numpy(), rare.values
            place, other = values.field("place").to_numpy(), values.field("groups").to_pylist()  # null: not the text's bytes
            # What a text of groups says itself doesn't travel: their number, and the tokens of B as the rest.
            text, own_a = values.field("groups"), values.field("n_a").to_numpy()
            n_groups, commas = (pc.count_substring(text.fill_null(""), x).to_numpy(zero_copy_only=False) for x in (";", ","))
            n_groups = n_groups.astype(np.int64) + 1
            others = np.stack([own_a, commas + 2 * n_groups - own_a, n_groups, *(values.field(c).to_numpy() for c in NUMBERS[3:])])
            for i, codes in enumerate(batch.column(batch.num_columns - 2)):
                if not codes.is_valid:
                    continue
                at = np.frombuffer(codes.as_py(), np.int32)
                known, low, high = at[at < size], int(bounds[i]), int(bounds[i + 1])
                if odd[known].any() or None in other[low:high]:
                    continue
                totals[i] = numbers[:, known].sum(axis=1)
                if len(known) < len(at):
                    times = np.bincount(at[at >= size] - size, minlength=high - low)
                    totals[i] += (others[:, low:high] * times[place[low:high]]).sum(axis=1)
                    own_texts = dict(zip((place[low:high] + size).tolist(), other[low:high], strict=True))
                    joined = ";".join([groups[c] if c < size else own_texts[c] for c in at.tolist()])
                else:
                    joined = ";".join([groups[c] for c in at.tolist()])
                digests[i] = hashlib.sha256(joined.encode()).hexdigest()
            columns = [pa.array(totals[:, k], pa.int64()) for k in range(len(NUMBERS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns, pa.array(digests, pa.string())], names=[*batch.schema.names[:-2], *NUMBERS, "groups_sha256"])

    inner = [f"c{i}" for i in range(len(keep))]
    schema = "".join(f"{c} {kind}, " for c, kind in rows.dtypes[: len(keep)]) + "".join(f"{c} long, " for c in NUMBERS) + "groups_sha256 string"
    others = others.select("piece", "n", F.when(F.col("same"), F.col("groups")).alias("groups"), "n_a", *NUMBERS[3:])
    made = pieces.assembled(rows, others, make, schema, ("groups", "n_a", *NUMBERS[3:]), tuple(inner))
    names = ("n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256")
    # Tokens have one byte at least, so one of each side ends at a cut: a link is a group's last pair.
    return made.select(*[F.col(i).alias(c) for i, c in zip(inner, keep, strict=True)], *names, F.col("n_groups").alias("n_links"))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
