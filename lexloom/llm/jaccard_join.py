"""Near-duplicate classes by an exact Jaccard join of word n-gram sets.

1. Every text becomes the set of its hashed n-grams. Texts with one set are one
   node from here on, named by a fingerprint of the set; so exact copies cost
   nothing further. Where two sets have one fingerprint, a second one tells them
   apart. A sketch of fixed size counts in how many texts each n-gram is, and each
   node keeps a profile: how many of its n-grams fall into each of some hash classes.
   The sum of the lesser counts bounds two sets' overlap from above.
2. Each set's n-grams are ordered by that count, rarest first; any two sets that
   link share one of the first size - ceil(t * size) + 1. These go to an index,
   dealt by n-gram, with the size of the set and the n-gram's position. N-grams of
   more than ``HOT`` sets (by the sketch) are dealt by set instead, and only the
   leader of their list is found by an aggregate, so no list has to fit in a task.
3. Relations in the index. A list is ordered by size and falls into runs, as no set
   links across a gap in size. Runs are first answered for their leader alone (the
   least node), exactly, then for a second leader from those that the first has not
   reached. What is then still open is searched in blocks of members of neighbouring
   positions: a block has the largest reach (n-grams from the position on) and the
   bounds of size of its members, and pairs of blocks in which no two members can
   have the overlap asked for are skipped whole.
4. Relations of answers. Members that the leaders' answers link are in one class,
   and from the overlaps of two members with the leader follow bounds of their own.
   What no bound decides is derived from the leader's answers incrementally: with A
   the leader's set and D the n-grams in which a member differs from it,
   |X & Y| = |X & A| + |Y & A| - |A| + |Dx & Dy|. So only differences are compared,
   and sets travel once, to their leaders.

The links of 3 and 4 connect all that all links connect. Sets travel as arrays of
64-bit hashes, and only those of pairs that the bounds leave open; a filter of
bounded size picks their texts where they are read, and a join does where there are
more of them than the filter may hold.

Defined results: texts null, or without words, have the empty set, and are
classes of their own. With fewer than n words the whole sequence is the set.
Rows that repeat a doc_id count each by its own text. A null doc_id is never the
least of a class. An empty table gives an empty one. Very long texts are hashed
whole. Only the columns named are returned; further ones of the input are left out,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .scratch import written
from .words import HASH, Words, blocks, integers, mix, released, released_group

BLOCK_BYTES = 1 << 20
#: The sketch: counters, and the parts that are summed apart.
COUNTERS, PARTS = 1 << 20, 64
#: Bytes of text for each bucket of the index.
BUCKET_BYTES = 8 << 20
#: Members of a list that one task compares with as many others, and n-grams of them at a time.
LIST_BLOCK, COLUMNS = 1024, 4096
#: Members of a block that is skipped as a whole, and sets of an n-gram beyond which its list is dealt by set.
SKIP_BLOCK, HOT = 128, 1 << 16
#: Texts that the filter may hold, at 16 bits each; beyond it the texts are joined.
FILTER_KEYS = 1 << 24


def _sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams and the text of each, in the order of texts."""
    h = w.hashes()
    grams = HASH.grams(h, n)
    valid = w.windows(n)[: len(grams)]
    text, grams = w.text[: len(grams)][valid], grams[valid]
    for few in range(1, n):
        own = np.flatnonzero(w.counts == few)
        if len(own):
            whole = HASH.grams(h, few)[w.first[own]]
            text, grams = np.concatenate([text, own]), np.concatenate([grams, mix(whole + np.uint64(few))])
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], text[new]


def _fingerprint(grams: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(mix(grams ^ np.uint64(salt))))
    size = np.diff(bounds).astype(np.uint64)
    return mix((total[bounds[1:]] - total[bounds[:-1]]) + size * np.uint64(0x9E37_79B9_7F4A_7C15)).astype(np.int64)


def _nodes(grams: np.ndarray, bounds: np.ndarray, clashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Name and second fingerprint of each set; bounds: where each begins, and the end. Names that several sets have are mixed with the second."""
    node, second = (_fingerprint(grams, bounds, x) for x in (0x5BF0_3635_4C1A_92E7, 0x3C79_AC49_2BA7_B653))
    if clashes is not None and len(clashes):
        node = np.where(np.isin(node, clashes), mix((node ^ second).astype(np.uint64)).astype(np.int64), node)
    return node, second


def _profile(grams: np.ndarray) -> bytes:
    """Counts of a set's n-grams by their low bits, about four to eight for each class."""
    classes = 1 << max(4, len(grams).bit_length() - 3)
    counts = np.bincount((grams & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    if counts.max() > 254:
        counts[:] = 255  # no bound but the other set's size
    return counts.astype(np.uint8).tobytes()


def _folded(profile: np.ndarray, classes: int) -> np.ndarray:
    """Profiles, one in each row, over fewer classes."""
    return profile.reshape(len(profile), -1, classes).sum(axis=1, dtype=np.int64)


def _within_profiles(percent: int):
    """Of rows (a, b, size_a, size_b, profile_a, profile_b) the pairs whose profiles allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [integers(batch, c) for c in ("size_a", "size_b")]
            need, keep = _needed(*sizes, percent), np.zeros(batch.num_rows, bool)
            for i, two in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8)[None, :] for v in two)
                classes = min(x.size, y.size)
                keep[i] = np.minimum(_folded(x, classes), _folded(y, classes)).sum() >= need[i]
            kept = pa.array(np.flatnonzero(keep & (100 * np.minimum(*sizes) >= percent * np.maximum(*sizes))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])

    return released(run)


def _digests(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("size", pa.int64()), ("node", pa.int64()), ("second", pa.int64()), ("profile", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for a, b, buf, offsets in blocks(batch, "text", BLOCK_BYTES):
                w = Words(buf, offsets, lower=True)
                grams, text = _sets(w, n)
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                counts += np.bincount((grams >> np.uint64(44)).astype(np.int64), minlength=COUNTERS).astype(np.int32)
                k = b - a
                profiles = pa.array([_profile(grams[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, k), batch.column(1).slice(a, k), pa.array(np.diff(bounds)), *map(pa.array, _nodes(grams, bounds)), profiles, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        squeeze = zstandard.ZstdCompressor(level=1)
        made = [squeeze.compress(x.tobytes()) for x in counts.reshape(PARTS, -1)]
        none = [pa.nulls(PARTS, pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([*none, pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(made, pa.binary())], schema=schema)

    return released(run)


def _renamed(digests: DataFrame, clashes: np.ndarray) -> DataFrame:
    """Digests with the names of ``_nodes`` for clashing sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, second = integers(batch, "node"), integers(batch, "second")
            node = np.where(np.isin(node, clashes), mix((node ^ second).astype(np.uint64)).astype(np.int64), node)
            yield batch.set_column(batch.schema.get_field_index("node"), "node", pa.array(node))

    return digests.mapInArrow(released(run), digests.schema)


def _sum_part(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // PARTS, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.int32)
    return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})


def _prefixes(n: int, percent: int, sent, buckets: int, hottest: int):
    """The index: rows of one n-gram and set where the n-gram is hot, else a blob of all of a bucket's."""
    schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("gram", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("pos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, (sketch, clashes) = zstandard.ZstdCompressor(level=1), sent.value
        for batch in batches:
            for _, _, buf, offsets in blocks(batch, "text", BLOCK_BYTES):
                w = Words(buf, offsets, lower=True)
                grams, text = _sets(w, n)
                bounds = np.searchsorted(text, np.arange(w.n_texts + 1))
                node, size = _nodes(grams, bounds, clashes)[0], np.diff(bounds)
                once = np.zeros(w.n_texts, bool)
                once[np.unique(node, return_index=True)[1]] = True
                count = sketch[(grams >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((grams, count, text))
                pos = np.arange(len(order)) - bounds[text]
                needed = size - (-(-size * percent // 100)) + 1
                keep = (pos < needed[text]) & once[text]
                grams, text, pos, hot = grams[order][keep], text[keep], pos[keep], count[order][keep] > hottest
                rows = np.stack([grams.astype(np.int64), node[text], size[text], pos])
                if hot.any():
                    many = int(hot.sum())
                    yield pa.RecordBatch.from_arrays([pa.nulls(many, pa.int64()), pa.nulls(many, pa.binary()), *map(pa.array, rows[:, hot])], schema=schema)
                rows, bucket = rows[:, ~hot], (grams[~hot] % np.uint64(buckets)).astype(np.int64)
                if not len(bucket):
                    continue
                order = np.argsort(bucket, kind="stable")
                bucket, rows = bucket[order], rows[:, order]
                cut = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
                made = [squeeze.compress(rows[:, x:y].tobytes()) for x, y in zip(cut, [*cut[1:], len(bucket)], strict=True)]
                none = [pa.nulls(len(cut), pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array(made, pa.binary()), *none], schema=schema)

    return released(run)


def _needed(size_a, size_b, percent: int):
    """Least overlap of two sets that link."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def _lists(percent: int):
    """Pairs of the leader of each list's runs with the members, and the members of runs of three or more."""
    schema = pa.schema([(x, pa.int64()) for x in ("list", "a", "b", "size", "pos")])

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.int64).reshape(4, -1) for x in table.column("blob")]
        gram, node, size, pos = np.concatenate(parts, axis=1)
        order = np.lexsort((node, gram))
        gram, node, size, pos = gram[order], node[order], size[order], pos[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        order = np.flatnonzero(new)
        order = order[np.lexsort((size[order], gram[order]))]
        gram, node, size, pos = gram[order], node[order], size[order], pos[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (100 * size[:-1] < percent * size[1:])
        run_no = np.cumsum(new)
        order = np.lexsort((node, run_no))
        node, size, pos = node[order], size[order], pos[order]
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(gram)))
        many = np.repeat(length >= 2, length)
        lead = np.repeat(first, length)
        at = np.flatnonzero(many & (np.arange(len(gram)) != lead))
        head = lead[at]
        open_ = 1 + np.minimum(size[head] - pos[head], size[at] - pos[at]) - 1
        fits = (100 * np.minimum(size[head], size[at]) >= percent * np.maximum(size[head], size[at])) & (open_ >= _needed(size[head], size[at], percent))
        pairs = np.unique(np.stack([node[head[fits]], node[at[fits]]]), axis=1)
        # Runs with the same members are one, at each member's least position.
        name = np.repeat(np.add.reduceat(mix(node.astype(np.uint64)), first), length).astype(np.int64) if len(gram) else node
        own = np.flatnonzero(np.repeat(length >= 3, length))
        order = own[np.lexsort((pos[own], node[own], name[own]))]
        new = np.ones(len(order), bool)
        new[1:] = (name[order[1:]] != name[order[:-1]]) | (node[order[1:]] != node[order[:-1]])
        own = order[new]
        leader = node[lead[own]]
        n = pairs.shape[1]
        columns = [pa.array([None] * n + name[own].tolist(), pa.int64()), np.append(pairs[0], leader), np.append(pairs[1], node[own]), pa.array([None] * n + size[own].tolist(), pa.int64()), pa.array([None] * n + pos[own].tolist(), pa.int64())]
        return pa.table(columns, schema=schema)

    return run


def _hot_lists(rows: DataFrame, percent: int) -> DataFrame:
    """The same as ``_lists`` from rows (gram, node, size, pos), by aggregates.

    Sizes fall into classes of one factor; sets that link are in one class or in two
    neighbouring ones, so each set is in the list of its class and in that before.
    """
    level = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(100 / percent)) * (1 + 1e-9))) if percent < 100 else F.col("size")
    rows = rows.select("gram", F.explode(F.array(level, level - 1)).alias("level"), "node", "size", "pos")
    rows = rows.groupBy("gram", "level", "node").agg(F.first("size").alias("size"), F.min("pos").alias("pos"))
    name = F.xxhash64(F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1))), F.count("*"))
    lead = rows.groupBy("gram", "level").agg(F.min(F.struct("node", "size", "pos")).alias("lead"), name.alias("list"), F.count("*").alias("many")).where("many >= 2")
    both = rows.join(lead, ["gram", "level"])
    need = F.ceil(F.lit(percent) * (F.col("size") + F.col("lead.size")) / F.lit(100 + percent))
    fits = (100 * F.least("size", "lead.size") >= percent * F.greatest("size", "lead.size")) & (F.least(F.col("size") - F.col("pos"), F.col("lead.size") - F.col("lead.pos")) >= need)
    none = [F.lit(None).cast("long").alias(c) for c in ("size", "pos")]
    pairs = both.where((F.col("node") != F.col("lead.node")) & fits).select(F.lit(None).cast("long").alias("list"), F.col("lead.node").alias("a"), F.col("node").alias("b"), *none).distinct()
    return pairs.union(both.where("many >= 3").select("list", F.col("lead.node").alias("a"), F.col("node").alias("b"), "size", "pos"))


def _profiles_allow(x: np.ndarray, y: np.ndarray, need: np.ndarray, profiles: list[np.ndarray]) -> np.ndarray:
    """Whether the profiles of members x[i] and y[i] allow the overlap need[i]."""
    classes = np.array([len(p) for p in profiles])
    ok, two = np.zeros(len(x), bool), np.stack([classes[x], classes[y]])
    for c, d in np.unique(two, axis=1).T.tolist():
        own, low = np.flatnonzero((two[0] == c) & (two[1] == d)), min(c, d)
        step = max(1, (1 << 21) // max(c, d))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            one, other = (_folded(np.stack([profiles[i] for i in v[part]]), low) for v in (x, y))
            ok[part] = np.minimum(one, other).sum(axis=1) >= need[part]
    return ok


def _open_members(percent: int):
    """Members of a list, or of two parts of one, that have a partner in another class which no bound excludes."""
    schema = pa.schema([("a", pa.int64()), ("node", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        names = ("a", "side", "node", "size", "pos", "label", "known")
        a, side, node, size, pos, label, known = (table.column(c).to_numpy() for c in names)
        order = np.lexsort((size, pos))
        side, node, size, pos, label, known = (x[order] for x in (side, node, size, pos, label, known))
        raw = table.column("profile").combine_chunks().take(pa.array(order))
        profiles = [np.frombuffer(x.as_buffer(), np.uint8) for x in raw]
        cuts = np.arange(0, len(node), SKIP_BLOCK)
        reach = np.maximum.reduceat(size - pos, cuts)
        low, high = np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts)
        one, other = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
        skip = (100 * high[:, None] < percent * low) | (100 * high < percent * low[:, None])
        skip |= np.minimum(reach[:, None], reach) < _needed(low[:, None], low, percent)
        skip |= (np.minimum(one[:, None], one) == np.maximum(other[:, None], other))
        wanted = np.zeros(len(node), bool)
        for p, q in zip(*np.nonzero(np.triu(~skip)), strict=True):
            i, j = (slice(int(k), int(k) + SKIP_BLOCK) for k in (cuts[p], cuts[q]))
            need = _needed(size[i, None], size[j], percent)
            ok = (label[i, None] != label[j]) & (np.minimum(size[i, None] - pos[i, None], size[j] - pos[j]) >= need)
            ok &= (100 * np.minimum(size[i, None], size[j]) >= percent * np.maximum(size[i, None], size[j])) & ~(wanted[i, None] & wanted[j])
            if side[0] >= 0:
                ok &= side[i, None] != side[j]
            most = np.minimum(known[i, None], known[j]) + np.minimum(size[i, None] - known[i, None], size[j] - known[j])
            ok &= (known[i, None] < 0) | (known[j] < 0) | (most >= need)
            if p == q:
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            kept = _profiles_allow(x + i.start, y + j.start, need[x, y], profiles)
            wanted[x[kept] + i.start] = wanted[y[kept] + j.start] = True
        return pa.table([np.full(int(wanted.sum()), a[0]), node[wanted]], schema=schema)

    return run


def _spanning(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between members those that a forest over their labels needs."""
    root = {}

    def find(v: int) -> int:
        while (up := root.setdefault(v, v)) != v:
            root[v] = root[up] if up in root else up
            v = up
        return v

    keep = []
    for i, (p, q) in enumerate(zip(label[x].tolist(), label[y].tolist(), strict=True)):
        p, q = find(p), find(q)
        if p != q:
            root[p] = q
            keep.append(i)
    return x[keep], y[keep]


def _links_within(percent: int):
    """Links between the classes of the members of one leader, or of two parts of them: as many as connect the classes that meet.

    Overlaps follow from those with the leader and from the n-grams in which both of two
    members differ from it; only n-grams in which at least two do are looked at.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        side, node, label, size, known, size_a = (table.column(c).to_numpy() for c in ("side", "node", "label", "size", "known", "size_a"))
        differ = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("differ")]
        flat, row = np.concatenate(differ), np.repeat(np.arange(len(differ)), [len(x) for x in differ])
        element, count = np.unique(flat, return_counts=True)
        element = element[count > 1]
        at = np.minimum(np.searchsorted(element, flat), max(0, len(element) - 1))
        hit = element[at] == flat if len(element) else np.zeros(len(flat), bool)
        row, at = row[hit], at[hit]
        common = (known[:, None] + known - size_a.max()).astype(np.float32)
        for low in range(0, len(element), COLUMNS):
            own = (at >= low) & (at < low + COLUMNS)
            matrix = np.zeros((len(differ), min(COLUMNS, len(element) - low)), np.float32)
            matrix[row[own], at[own] - low] = 1
            common += matrix @ matrix.T  # counts below 2**24: exact
        linked = np.triu(common >= _needed(size[:, None], size[None, :], percent), 1) & (label[:, None] != label[None, :])
        if side[0] >= 0:
            linked &= side[:, None] != side[None, :]
        x, y = np.nonzero(linked)
        if len(x):
            two = np.sort(np.stack([label[x], label[y]]), axis=0)
            once = np.unique(two, axis=1, return_index=True)[1]
            x, y = x[once], y[once]
            x, y = _spanning(x, y, label)
        return pa.table([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], schema=schema)

    return run


def _parted(rows: DataFrame, key: str) -> DataFrame:
    """A key's rows dealt over parts of about LIST_BLOCK; each part meets each other in a group (key, p, q) of its own."""
    many = rows.groupBy(key).agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("parts"))
    rows = rows.join(many, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part"))
    # Where a part meets itself its rows come once; where two parts meet, each with its number as side.
    return rows.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other"), "side": side}).drop("parts", "part", "other")


def _key_filter(keys: DataFrame) -> np.ndarray | None:
    """Filter of the keys (column row): words of 64 bits, two bits of one word for each key. None if they are too many."""
    many = keys.count()
    if many > FILTER_KEYS:
        return None
    words = 1 << max(10, (many // 4).bit_length())  # 32 MB at most
    bits = F.expr("shiftleft(1L, cast(shiftrightunsigned(row, 40) & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(row, 46) & 63 as int))")
    made = keys.groupBy(F.col("row").bitwiseAND(F.lit(words - 1)).alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[made.column("word").to_numpy()] = made.column("bits").to_numpy()
    return out.astype(np.uint64)


def _set_arrays(n: int, clashes: np.ndarray, sent=None):
    """Sets of the texts whose row the filter (all, without one) lets pass."""
    _1, _63 = np.uint64(1), np.uint64(63)

    def passing(row: np.ndarray) -> np.ndarray:
        row = row.astype(np.uint64)
        bits = (_1 << (row >> np.uint64(40) & _63)) | (_1 << (row >> np.uint64(46) & _63))
        return sent.value[(row & np.uint64(len(sent.value) - 1)).astype(np.int64)] & bits == bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent is not None:
                batch = batch.filter(pa.array(passing(integers(batch, "row"))))
            for a, b, buf, offsets in blocks(batch, "text", BLOCK_BYTES):
                grams, text = _sets(Words(buf, offsets, lower=True), n)
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                made = [grams[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_nodes(grams, bounds, clashes)[0]), pa.array(made, pa.binary())], names=["row", "made", "grams"])

    return released(run)


def _fetched(own: DataFrame, nodes: DataFrame, asked: DataFrame, n: int, clashes: np.ndarray) -> DataFrame:
    """node and grams (its set) of the asked nodes, written."""
    chosen = written(nodes.select("node", "row").join(asked, "node", "left_semi"), "asked")
    bits = _key_filter(chosen)
    texts, schema = own.select("row", "text"), "row long, made long, grams binary"
    sent = None if bits is None else own.sparkSession.sparkContext.broadcast(bits)
    if sent is None:
        texts = texts.join(chosen.select("row"), "row", "left_semi")
    sets = texts.mapInArrow(_set_arrays(n, clashes, sent), schema)
    # Two texts of one row key have different sets, and equal rows the same: one of the right ones is taken.
    sets = sets.join(chosen, "row").where("made = node").select("node", "grams")
    made = written(sets.dropDuplicates(["node"]), "sets")
    if sent is not None:
        sent.destroy()
    return made


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        sizes, common, differ = ([], []), [], []
        for p, q in zip(x, y, strict=True):
            one, two = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            merged = np.concatenate([one, two])
            merged.sort()
            again = merged[1:] == merged[:-1]
            common.append(int(again.sum()))
            differ.append(merged[~(np.append(again, False) | np.append(False, again))].tobytes())
            sizes[0].append(len(one)), sizes[1].append(len(two))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (*sizes, common)), pa.array(differ, pa.binary())], names=["a", "b", "size_a", "size_b", "common", "differ"])


_OVERLAPS = "a long, b long, size_a long, size_b long, common long, differ binary"


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact overlaps of the pairs (a, b), and the n-grams that one of the two has. A node with very many pairs has its set copied for each few hundred."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).cast("int").alias("copies"))
    salted = pairs.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    left = copies.join(sets, copies.a == sets.node).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    rows = salted.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "x", "y")
    return rows.mapInArrow(released(_overlaps), _OVERLAPS)


def row_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """Key of a row by its doc_id and text; equal rows have equal keys."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, row (its row_key), n_shingles, component_id and first (whether the row is the one of its class to keep).

    Sets link whose Jaccard similarity is percent/100 or more.
    """
    spark = docs.sparkSession
    plain = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(text, doc_id).alias("row"), plain.alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(64, size // BUCKET_BYTES))

    made = written(own.mapInArrow(_digests(n), "doc_id long, row long, size long, node long, second long, profile binary, part int, counts binary"), "digests")
    summed = made.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(released_group(_sum_part), "part int, counts binary").collect()  # PARTS rows, 4 MB
    sketch = np.zeros((PARTS, COUNTERS // PARTS), np.int32)
    for r in summed:
        sketch[r.part] = np.frombuffer(r.counts, np.int32)
    digests = made.where("part is null").select("doc_id", "row", "size", "node", "second", "profile")
    first = F.min(F.struct("row", "size", "profile"))
    nodes = written(digests.where("size > 0").groupBy("node").agg(first.alias("x"), (F.min("second") != F.max("second")).alias("clash")).select("node", "x.*", "clash"), "nodes")
    # Sets of one name: 10**10 sets have about three such pairs.
    clashes = np.array([r.node for r in nodes.where("clash").select("node").toLocalIterator()], np.int64)
    if len(clashes):
        digests = _renamed(digests, clashes)
        nodes = written(digests.where("size > 0").groupBy("node").agg(first.alias("x")).select("node", "x.*"), "nodes")

    sent = spark.sparkContext.broadcast((sketch.reshape(-1), clashes))
    index = own.select("text").mapInArrow(_prefixes(n, percent, sent, buckets, HOT), "bucket long, blob binary, gram long, node long, size long, pos long")
    hot = bool((sketch > HOT).any())
    index = written(index, "index") if hot else index  # it is read twice then
    lists = index.where("bucket is not null").groupBy("bucket").applyInArrow(released_group(_lists(percent)), "list long, a long, b long, size long, pos long")
    if hot:
        lists = lists.union(_hot_lists(index.where("bucket is null").select("gram", "node", "size", "pos"), percent))
    found = written(lists, "lists")
    sent.destroy()
    members = found.where("list is not null").groupBy("list", "a", F.col("b").alias("node")).agg(F.first("size").alias("size"), F.min("pos").alias("pos"))
    members = written(members, "members")

    def exact(pairs: DataFrame) -> DataFrame:
        sets = _fetched(own, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), n, clashes)
        return written(_compared(pairs, sets), "overlaps")

    def answered(pairs: DataFrame) -> DataFrame:
        """Exact overlaps of the pairs that sizes and profiles leave open."""
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("profile").alias(f"profile_{c}"))
        rows = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "profile_a", "profile_b")
        rows = written(rows.mapInArrow(_within_profiles(percent), "a long, b long"), "pairs")
        return rows.sparkSession.createDataFrame([], _OVERLAPS) if rows.isEmpty() else exact(rows)

    def with_labels(classes: DataFrame) -> DataFrame:
        rows = members.join(classes, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        spread = rows.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        return written(rows.join(spread.select("list"), "list", "left_semi"), "labelled")

    links = f"100 * common >= {percent} * (size_a + size_b - common)"
    first = answered(found.where("list is null").select("a", "b"))
    linked = first.where(links).select("a", "b")
    classes = components(linked)
    labelled = with_labels(classes)

    # The second leader of a run is the least node that is not in the class of the first.
    lead = labelled.where("node = a").select("list", F.col("label").alias("lead"))
    rest = labelled.join(lead, "list").where("label <> lead").select("list", "node", "label")
    second = rest.groupBy("list").agg(F.min(F.struct("node", "label")).alias("x")).select("list", F.col("x.node").alias("a"), F.col("x.label").alias("own"))
    more = answered(rest.join(second, "list").where("label <> own").select("a", F.col("node").alias("b")))
    more = more.where(links).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not more.isEmpty():
        linked = linked.union(more)
        classes = components(linked)
        labelled = with_labels(classes)

    answers = first.select("a", F.col("b").alias("node"), F.col("common").alias("known"))
    still = labelled.join(answers, ["a", "node"], "left").withColumn("known", F.coalesce("known", F.lit(-1))).join(nodes.select("node", "profile"), "node")
    opened = _parted(still, "list").groupBy("list", "p", "q").applyInArrow(released_group(_open_members(percent)), "a long, node long").distinct()
    opened = written(opened.join(labelled.select("node", "size", "label").distinct(), "node"), "open")
    if not opened.isEmpty():
        # Members whose overlap with the leader the bounds had ruled out as a link still need it to derive the others' from.
        asked = opened.where("node <> a").select("a", F.col("node").alias("b")).join(first.select("a", "b"), ["a", "b"], "left_anti")
        asked = written(asked, "pairs")
        known = first if asked.isEmpty() else first.union(exact(asked))
        known = known.select("a", F.col("b").alias("node"), "size_a", F.col("common").alias("known"), "differ")
        own_set = F.col("node") == F.col("a")
        rows = opened.join(known, ["a", "node"], "left")
        rows = rows.withColumns({"known": F.when(own_set, F.col("size")).otherwise(F.col("known")), "size_a": F.when(own_set, F.col("size")).otherwise(F.col("size_a")), "differ": F.coalesce("differ", F.lit(b""))})
        last = _parted(rows, "a").groupBy("a", "p", "q").applyInArrow(released_group(_links_within(percent)), "a long, b long")
        classes = components(written(linked.union(last), "links"))

    named = digests.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = named.where("size > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first_row"))
    out = named.join(least, "class", "left")
    alone = F.col("size") == 0
    return out.select("doc_id", "row", F.col("size").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), (alone | (F.col("row") == F.col("first_row"))).alias("first"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, n=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i + 1, i + 4), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""
