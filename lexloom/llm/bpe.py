"""Byte-level BPE encoding and decoding.

The texts are cut by the tokenizer's pattern into pieces. Pieces that come often are
counted over all texts first, and each of them is encoded once for the whole corpus:
the ``frequent`` most frequent ones, by a threshold that all of one count pass or
fail together. Their ids are sent to all tasks (at most ``FREQUENT`` pieces of at most
``FOLD_BYTES`` bytes, so some 40 MB). They only save work: any other piece is encoded
where it is met, with the same result.

Where a task reads a text, it numbers the pieces that it meets for the first time
and sends, for each document, the numbers of its pieces and the bytes of the new
ones; so a task encodes each distinct rare word once, and no text or answer is
shuffled, only counts of words. Rows carry their running number between the two
steps, and a row out of turn is an error.

Encoding folds the ranked merges of a distinct piece in Spark higher-order
functions. A token is written as one character, by its rank, so a piece is a string
of as many characters as it has bytes, beside a string of the ranks of its pairs of
neighbours. In each step the least character of the second says which pair to join
and what it becomes, and its two new pairs are looked up in a literal rank map, until
no pair has a rank. Then each document's numbers are replaced by the ids of the
pieces. Decoding concatenates the pieces of the ids, as characters that stand for
one byte each.

A task forgets its own numbers when there are ``NUMBERED`` of them, so its memory is
bounded; words that come again are then encoded again.

Defined results: null and empty texts have no ids. A piece that has a rank itself is
one token, as in the library. Pieces of more than ``FOLD_BYTES`` bytes, whose fold
would take quadratic time, are merged with a heap in Python instead, by the same
ranks. Repeated rows are encoded alike; an empty table gives an empty one. Very long
texts are cut and numbered whole, one at a time. Columns of the input that are named
like a result's are replaced; others pass through.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import short_plans, written
from .words import release, released

NUMBERED, FOLD_BYTES, FREQUENT = 1 << 18, 64, 5 << 17
#: Strings, at least, that the literal rank map is dealt over by hash, so that a look-up reads one or two entries.
RANK_CLASSES = 1 << 16
#: Stands for no rank, after all ranks in order.
NONE = chr(0x10FFFF)


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x.strip())}


def _char(rank: int) -> str:
    """A character for each rank, in their order; surrogates are left out."""
    return chr(rank + 1 if rank + 1 < 0xD800 else rank + 1 + 0x800)


def spark_hash(x: bytes) -> int:
    """What Spark's ``hash`` gives for a string of these UTF-8 bytes: 32-bit Murmur3 with seed 42, its last bytes one by one."""
    whole, full = len(x) // 4 * 4, 0xFFFFFFFF
    h = 42
    for k in [int.from_bytes(x[i : i + 4], "little") for i in range(0, whole, 4)] + [b - 256 if b > 127 else b for b in x[whole:]]:
        k = k * 0xCC9E2D51 & full
        k = (k << 15 | k >> 17) * 0x1B873593 & full
        h ^= k
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & full
    h ^= len(x)
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def rank_map(ranks: dict[bytes, int]) -> Column:
    """Literal rank map from pairs of tokens to what they join to: an array of strings, each of entries NONE, pair, rank, and NONE at its end.

    A look-up searches its string for the pair alone, which may begin or end with NONE.
    All that it could find besides an entry's pair is two other neighbours: NONE and the
    first token, the second token and the rank, the rank and NONE. So the number of
    strings is chosen such that no such neighbours are dealt to the string they are in.
    """
    entries = []
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            both = ranks.get(piece[:i]), ranks.get(piece[i:])
            if None not in both:
                entries.append(_char(both[0]) + _char(both[1]) + _char(rank))
    neighbours = [[(NONE + x + NONE)[a : a + 2] for x in entries] for a in (1, 0, 2, 3)]
    hashes = {x: spark_hash(x.encode()) for x in set().union(*neighbours)}
    of_pairs, *others = (np.array([hashes[x] for x in part], np.int64) for part in neighbours)
    size = RANK_CLASSES
    while any((of_pairs % size == x % size).any() for x in others):
        size += 1
        if size > RANK_CLASSES + (1 << 14):
            raise ValueError("no number of strings keeps the neighbours in the rank map apart")
    classes = [""] * size
    for at, entry in zip((of_pairs % size).tolist(), entries, strict=True):
        classes[at] += NONE + entry
    return F.from_json(F.lit(json.dumps([x + NONE for x in classes], separators=(",", ":"), ensure_ascii=False)), "array<string>")


def let(x: Column, use) -> Column:
    """use(x), with x computed and written into the plan once: a one-entry transform names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def fold_merges(piece: Column, bytes_as: str, maps: Column) -> Column:
    """Ids of a piece (a string), by repeated merges of the neighbours of least rank, leftmost first; bytes_as: the tokens of the 256 bytes."""
    none, one = F.lit(NONE), F.lit(1)

    def rank(pair: Column) -> Column:
        # What follows the entry's pair; without an entry that is all of the string, which begins with NONE.
        own = F.get(maps, F.pmod(F.hash(pair), F.size(maps)))
        return F.substring(F.call_function("substring_index", own, pair, F.lit(-1)), one, one)

    def step(state: Column, _: Column) -> Column:
        parts, pairs = state["parts"], state["pairs"]  # pairs: rank of each part joined with the next

        def joined(token: Column):
            def at(i: Column) -> Column:
                def ranked(made: Column) -> Column:
                    new = F.concat(rank(F.substring(made, i - 1, F.lit(2))), rank(F.substring(made, i, F.lit(2))))
                    return F.struct(made.alias("parts"), F.overlay(pairs, new, i - 1, F.lit(3)).alias("pairs"))

                return let(F.overlay(parts, token, i, F.lit(2)), ranked)

            return at

        # Where no pair has a rank, pairs becomes empty, and the steps that are left do nothing.
        done = F.struct(parts.alias("parts"), F.lit("").alias("pairs"))
        least = let(F.array_min(F.split(pairs, "")), lambda token: F.when(token == none, done).otherwise(let(F.instr(pairs, token), joined(token))))
        return F.when(pairs == "", state).otherwise(least)

    n = F.octet_length(piece)
    latin = "".join(map(chr, range(256)))
    # A part at both ends that joins with nothing, so that each merge has neighbours.
    single = F.concat(none, F.translate(F.decode(piece.cast("binary"), "ISO-8859-1"), latin, bytes_as), none)
    ranked = lambda x: F.concat(none, F.array_join(F.transform(F.sequence(F.lit(2), n), lambda i: rank(F.substring(x, i, F.lit(2)))), ""), none)
    ranked_all = lambda x: F.when(n > 1, ranked(x)).otherwise(none)
    start = let(single, lambda x: F.struct(x.alias("parts"), ranked_all(x).alias("pairs")))
    folded = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), start, step, lambda s: s["parts"])
    inner = let(folded, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    code = lambda c: F.ascii(c) - F.when(F.ascii(c) < 0xD800, 1).otherwise(0x801)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(inner, ""), code))


def byte_tokens(ranks: dict[bytes, int]) -> str:
    return "".join(_char(ranks[bytes([b])]) for b in range(256))


def _heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long piece, in n log n steps."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i], parts[j]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else -1
        if j < 0 or parts[i] is not a or parts[j] is not b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[x] for x in parts if x is not None]


def _lists(flat: np.ndarray, ends: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat, pa.int32()))


def frequent_pieces(texts: DataFrame, ranks: dict[bytes, int], literal: Column, most: int = FREQUENT) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """At most ``most`` words between spaces (column text_) that come more than once, their ids one after another, and how many each has."""
    each = texts.select(F.explode(F.split("text_", " ")).alias("word")).where(F.octet_length("word").between(1, FOLD_BYTES - 1))
    words = each.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").where(F.col("word").rlike(r"^\p{L}+$"))
    # Between spaces, a word is a piece together with the space before it.
    counted = written(words.select(F.concat(F.lit(" "), "word").alias("piece"), "n"), "pieces")
    level = F.floor(F.log2("n") * 8).cast("int")
    left, least, rows = most, None, 0
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):  # 8 * 63 rows at most
        left -= r["count"]
        if left < 0:
            break
        least, rows = r.level, rows + r["count"]
    if least is None:
        return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
    dealt = counted.where(level >= least).select("piece").repartition(max(1, rows // 8192), "piece")
    folded = dealt.select("piece", let(literal, lambda r: fold_merges(F.col("piece"), byte_tokens(ranks), r)).alias("ids"))
    with short_plans(texts.sparkSession):
        made = folded.toArrow().combine_chunks()
    ranked = pa.array([y for x in ranks if x.decode(errors="ignore").encode() == x and (y := x.decode())], pa.string())
    made = made.filter(pc.invert(pc.is_in(made.column("piece"), ranked))).combine_chunks()
    if not made.num_rows:
        return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
    ids, many = _flat(made.column("ids").chunk(0))
    return made.column("piece").chunk(0), ids.astype(np.int32), many


def _numbered(pattern: str, sent, names: list[str], numbered: int):
    """Columns ``names``, place (running number of the row), fresh (whether numbers begin again after the frequent pieces'), pieces (the new ones), done (ids of a new one that needs no fold) and numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, (ranks, words) = regex.compile(pattern).findall, sent.value
        known = {x: i for i, x in enumerate(words.to_pylist())}
        # Numbers of frequent pieces stay; a task's own ones are in a small table of their own, which may be forgotten.
        base, own, place = len(known), {}, 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                fresh, numbers, ends, pieces, many, done = [], [], [], [], [], []
                for text in part.column(len(names)).to_pylist():
                    fresh.append(len(own) > numbered)
                    if fresh[-1]:
                        own.clear()
                    found, new, at = find(text or ""), [], -1
                    each = list(map(known.get, found))
                    for _ in range(each.count(None)):
                        at = each.index(None, at + 1)
                        x = found[at]
                        if (i := own.get(x)) is None:
                            i = own[x] = base + len(own)
                            new.append(x)
                        each[at] = i
                    numbers += each
                    ends.append(len(numbers))
                    for x in new:
                        raw = x.encode()
                        at = ranks.get(raw)  # a piece that has a rank is one token
                        ready = [at] if at is not None else _heap_merge(raw, ranks) if len(raw) > FOLD_BYTES else None
                        done.append(ready)
                        pieces.append(x if ready is None else "")
                    many.append(len(pieces))
                of_rows = pa.array(np.append(0, many), pa.int32())
                places = pa.array(np.arange(place, place + part.num_rows))
                place += part.num_rows
                columns = [places, pa.array(fresh, pa.bool_()), pa.ListArray.from_arrays(of_rows, pa.array(pieces, pa.string())), pa.ListArray.from_arrays(of_rows, pa.array(done, pa.list_(pa.int32()))), _lists(np.array(numbers, np.int32), ends)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *columns], names=[*names, "place", "fresh", "pieces", "done", "numbers"])
        known.clear()

    return released(run)


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]], one after another."""
    if not len(lengths):
        return values[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(len(shift))]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _put_together(names: list[str], sent):
    """Columns ``names`` and ids: each document's numbers replaced by the ids of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = sent.value
        base = used, count = len(known), len(own)  # of the table of ids, and of the pieces in it
        values, lengths = (np.append(x, np.zeros(1 << 16, np.int32)) for x in (known, own))
        starts, place = np.append((np.cumsum(own) - own).astype(np.int32), np.zeros(1 << 16, np.int32)), 0
        for batch in batches:
            at = {x: i for i, x in enumerate(batch.schema.names)}
            if not np.array_equal(batch.column(at["place"]).to_numpy(), np.arange(place, place + batch.num_rows)):
                raise RuntimeError("rows out of turn between numbering and encoding")
            place += batch.num_rows
            begins = np.flatnonzero(batch.column(at["fresh"]).to_numpy(zero_copy_only=False))
            cuts = sorted({0, batch.num_rows, *begins.tolist(), *range(0, batch.num_rows, 256)})
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(low, high - low)
                if part.column(at["fresh"])[0].as_py():
                    used, count = base
                ids, own = _flat(part.column(at["encoded"]).flatten())
                while used + len(ids) > len(values):
                    values = np.append(values, np.zeros_like(values))
                while count + len(own) > len(starts):
                    starts, lengths = np.append(starts, np.zeros_like(starts)), np.append(lengths, np.zeros_like(lengths))
                values[used : used + len(ids)] = ids
                starts[count : count + len(own)] = used + np.cumsum(own) - own
                lengths[count : count + len(own)] = own
                used, count = used + len(ids), count + len(own)
                numbers, many = _flat(part.column(at["numbers"]))
                total = np.append(0, np.cumsum(lengths[numbers]))
                ids = _lists(_gathered(values, starts[numbers], lengths[numbers]), total[np.cumsum(many)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], ids], names=[*names, "ids"])

    return released(run)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_text: bool = True, numbered: int = NUMBERED, frequent: int = FREQUENT) -> DataFrame:
    """Columns of ``docs`` (without the text, if that is not to be kept) and ``ids``, the array of token ids of the text."""
    docs = docs.drop("ids")
    kept = [c for c in docs.columns if keep_text or c != text]
    names = [f"c{i}" for i in range(len(kept))]
    plain = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(kept, names, strict=True)], F.col(f"`{text}`").alias("text_"))
    schema = "".join(f"{c} {kind}, " for c, kind in plain.dtypes[: len(names)])
    literal = rank_map(ranks)
    words, ids, many = frequent_pieces(plain.select("text_"), ranks, literal, frequent)
    # Each of a row's two workers takes up its own part only.
    sent, sent_ids = (docs.sparkSession.sparkContext.broadcast(x) for x in ((ranks, words), (ids, many.astype(np.int32))))
    del words, ids, many
    release()  # the driver's memory, too, where many queries follow one another
    met = plain.mapInArrow(_numbered(pattern, sent, names, numbered), schema + "place long, fresh boolean, pieces array<string>, done array<array<int>>, numbers array<int>")
    encoded = let(literal, lambda r: F.zip_with("pieces", "done", lambda piece, done: F.coalesce(done, fold_merges(piece, byte_tokens(ranks), r))))
    ready = met.select(*names, "place", "fresh", encoded.alias("encoded"), "numbers")
    made = ready.mapInArrow(_put_together(names, sent_ids), schema + "ids array<int>")
    return made.toDF(*kept, "ids")


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Columns of ``tokens`` and ``decoded``, the bytes of its column ``ids``; null ids decode to no bytes."""
    tokens = tokens.drop("decoded")
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    literal = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    # Spark joins strings only, so a byte travels as the character of its number.
    joined = F.array_join(F.transform("ids", lambda i: F.get(literal, i)), "")
    return tokens.select("*", F.encode(F.coalesce(joined, F.lit("")), "ISO-8859-1").alias("decoded"))


def round_trip(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` but text, and digests of the ids of each text and of what they decode to."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    back = decode(encode(docs, ranks, public_tokenizers.PATTERN, keep_text=False), ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select(*[c for c in docs.columns if c != "text"], F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
