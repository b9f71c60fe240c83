"""Term and prefix matching as hash joins on runs of tokens and on prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import codes

# Fixed value: the characters of words, for the boundaries of terms.
WORD = r"[\p{L}\p{N}_À-ɏ]"


def _tokens(x: Column) -> Column:
    """Words, and each other character by itself, each with the number of its word or of the word before the gap it is in."""
    parts = F.regexp_extract_all(x, F.lit(f"({WORD}+|[^{WORD[1:-1]}]+)"), F.lit(1))
    token = lambda t, k, word: F.struct(t.alias("t"), F.floor(k / 2).cast("int").alias("pos"), F.lit(word).alias("word"))
    gap = lambda p, k: F.transform(F.regexp_extract_all(p, F.lit("(?s)(.)"), F.lit(1)), lambda t: token(t, k, False))
    return F.flatten(F.transform(parts, lambda p, k: F.when(p.rlike(f"^{WORD}"), F.array(token(p, k, True))).otherwise(gap(p, k))))


#: Buckets of the filters of terms: by first tokens, and by whole terms.
FIRSTS, WHOLES = 1 << 20, 1 << 22
#: Distinct lengths of terms that have a bit of their own; longer ones share the last.
LENGTHS = 63


def _filters(wanted: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The terms' numbers of tokens, for each bucket of first tokens the bits of those it goes on to, and the buckets of whole terms.

    The driver gets numbers of buckets, not terms, so what it holds and sends is bounded.
    """
    sizes = sorted(r.n_ for r in wanted.select("n_").distinct().collect())
    bit = F.least(F.array_position(F.array(*map(F.lit, sizes)), F.col("n_")) - 1, F.lit(LENGTHS)).cast("int") if sizes else F.lit(0)
    firsts, wholes = np.zeros(FIRSTS, np.uint64), np.zeros(WHOLES, bool)
    seen = wanted.select(F.pmod(F.crc32("first_"), F.lit(FIRSTS)).alias("at"), bit.alias("bit")).distinct().toArrow()
    np.bitwise_or.at(firsts, seen.column("at").to_numpy(), np.uint64(1) << seen.column("bit").to_numpy().astype(np.uint64))
    wholes[wanted.select(F.pmod(F.crc32("src"), F.lit(WHOLES)).alias("at")).distinct().toArrow().column("at").to_numpy()] = True
    return sizes, firsts, wholes


def _candidates(sent, names: list[str]):
    """Columns ``names``, src, pos and at of all runs of tokens that the filters let pass; the text is the last column of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        sizes, firsts, wholes = sent.value
        parts_of = regex.compile(f"{WORD}+|[^{WORD[1:-1]}]+").findall
        is_word = regex.compile(WORD).match
        known: dict[str, list[int]] = {}

        def lengths(token: str) -> list[int]:
            bits = int(firsts[zlib.crc32(token.encode()) % FIRSTS])
            found = [n for i, n in enumerate(sizes) if bits >> min(i, LENGTHS) & 1] if bits else []
            if len(known) >= 1 << 16:
                known.clear()
            known[token] = found
            return found

        def hits(text: str) -> Iterator[tuple[str, int, int]]:
            parts = parts_of(text)
            # Tokens: words and single other characters; words and gaps take turns.
            odd = 0 if parts and is_word(parts[0]) else 1
            tokens: list[str] = []
            begins: list[tuple[int, int, list[int]]] = []
            for k, part in enumerate(parts):
                if k % 2 == odd:
                    found = known.get(part)
                    if found is None:
                        found = lengths(part)
                    if found:
                        begins.append((len(tokens), k, found))
                    tokens.append(part)
                    continue
                for i, c in enumerate(part):
                    if i or not k:
                        found = known.get(c)
                        if found is None:
                            found = lengths(c)
                        if found:
                            begins.append((len(tokens), k, found))
                    tokens.append(c)
            many = len(tokens)
            for at, k, found in begins:
                for n in found:
                    end = at + n
                    if end > many:
                        break
                    if end < many and is_word(tokens[end]):
                        continue
                    own = tokens[at] if n == 1 else "".join(tokens[at:end])
                    if wholes[zlib.crc32(own.encode()) % WHOLES]:
                        yield own, k // 2, at

        for batch in batches:
            rows, src, pos, places = [], [], [], []
            for row, text in enumerate(batch.column(len(names)).to_pylist()):
                for own, p, at in hits(text) if text else ():
                    rows.append(row)
                    src.append(own)
                    pos.append(p)
                    places.append(at)
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(names)]]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(src, pa.string()), pa.array(pos, pa.int32()), pa.array(places, pa.int32())], names=[*names, "src", "pos", "at"])

    return run


def term_hits(rows: DataFrame, terms: DataFrame, keys: list[str], text: str = "text", longest: int | None = None) -> DataFrame:
    """(keys, src, pos, at): terms that stand in a text, letter by letter, where no word's character is just before or after.

    ``pos`` is the place among words, ``at`` that among tokens (words, and single other
    characters). A term begins and ends with any character; those with a backslash or a
    bracket are no terms. Where a text is read, filters of fixed size (by hashes of the
    terms' first tokens, of their lengths and of whole terms) leave few of its runs of
    tokens; these are joined to the terms, which decides. So there may be any number of
    terms. Case matters. Terms of more than ``longest`` words are left out
    where it is given. Null and empty texts and terms have no hits; a term that is there
    twice counts once.
    """
    wanted = terms.where(~F.col("src").rlike(r"[\\\[\]]") & (F.col("src") != "")).select("src").distinct().withColumn("t_", _tokens(F.col("src")))
    if longest is not None:
        wanted = wanted.where(F.size(F.filter("t_", lambda x: x["word"])) <= longest)
    wanted = wanted.select("src", F.size("t_").alias("n_"), F.get("t_", F.lit(0))["t"].alias("first_"))
    sent = rows.sparkSession.sparkContext.broadcast(_filters(wanted))
    schema = "".join(f"`{c}` {kind}, " for c, kind in rows.select(*keys).dtypes) + "src string, pos int, at int"
    found = rows.select(*keys, F.col(text).alias("text_")).mapInArrow(_candidates(sent, keys), schema)
    return found.join(wanted.select("src"), "src").select(*keys, "src", "pos", "at")


def first_term(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The leftmost hit of each text, the longest of those at one place."""
    best = F.min_by("src", F.struct("at", (-F.length("src")).alias("longer"), "src"))
    return hits.groupBy(*keys).agg(best.alias("src"))


def hit_terms(hits: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """A map of all terms of each text to their translations."""
    found = hits.select(*keys, "src").distinct().join(terms.select("src", "dst"), "src")
    return found.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "dst")))).alias("terms"))


def longest_prefix(rows: DataFrame, prefixes: DataFrame, keys: list[str], text: str = "text", boundary: str = r"[ .,:;!?\]\)]") -> DataFrame:
    """(keys, prefix, dst): the longest known prefix of each text that is all of it or ends before a boundary.

    Each text offers its own prefixes of the lengths that known ones have, so that the
    lookup is a join by hash.
    """
    x = F.col(text)
    lengths = prefixes.where(F.length("prefix") > 0).agg(F.collect_set(F.length("prefix")).alias("lengths"))
    ends = F.filter("lengths", lambda n: (n == F.length(x)) | ((n < F.length(x)) & F.substring(x, n + 1, F.lit(1)).rlike(boundary)))
    own = rows.where(F.length(x) > 0).crossJoin(F.broadcast(lengths)).select(*keys, F.explode(F.transform(ends, lambda n: F.substring(x, F.lit(1), n))).alias("prefix"))
    found = own.join(prefixes.select("prefix", "dst"), "prefix")
    best = found.groupBy(*keys).agg(F.max_by(F.struct("prefix", "dst"), F.length("prefix")).alias("x"))
    return best.select(*keys, "x.*")


def with_fallback(rows: DataFrame, layers: list[tuple[DataFrame, list[str]]], value: str, default: Column) -> DataFrame:
    """``value`` from the first layer that has it, by each layer's own keys, else the default."""
    out, found = rows, []
    for i, (layer, keys) in enumerate(layers):
        name = f"found_{i}"
        out = out.join(layer.select(*keys, F.col(value).alias(name)), keys, "left")
        found.append(name)
    return out.withColumn(value, F.coalesce(*found, default)).drop(*found)


def known_prefix(rows: DataFrame, prefixes: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, prefix, dst, rest): the longest known prefix that ends with one of the control codes at the start of a text.

    Each text offers its own prefixes, one for each leading code, so the lookup is a join by hash.
    """
    x = F.col(text)
    own = rows.select(*keys, x.alias("text_"), F.explode(F.transform(codes.boundaries(x), lambda n: F.substring(x, F.lit(1), n))).alias("prefix"))
    found = own.join(prefixes.select("prefix", "dst"), "prefix")
    best = found.groupBy(*keys).agg(F.max_by(F.struct("prefix", "dst", F.expr("substring(text_, length(prefix) + 1)").alias("rest")), F.length("prefix")).alias("x"))
    return best.select(*keys, "x.*")
