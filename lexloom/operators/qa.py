"""Quality checks of translations (src, dst): one projection of nullable details, then one row for each finding."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.text import strip
from . import codes

# Words of the checks' alphabet.
LATIN = "A-Za-zÁÉÍÓÚÑÜáéíóúñü"
PLACEHOLDER, PAIRS = codes.PLACEHOLDER, codes.PAIRS
SYMBOLS = {"control": codes.CONTROL, "tag": codes.TAG, "brace": codes.BRACE}


def residual_latin(dst: Column, white: list[str], most: int = 8) -> Column:
    """Latin words left in a translation, codes taken off, that are not on the white list, the first few."""
    found = codes.found(codes.strip_controls(dst), f"[{LATIN}]{{3,}}")
    return F.slice(F.filter(found, lambda w: ~F.lower(w).isin(white or [""])), 1, most)


def unbalanced(src: Column, dst: Column) -> Column:
    """Pairs that the source has in balance: directed ones of which the translation has both, in other numbers, and undirected ones of odd number."""
    # Codes are taken off once for all pairs: an expression named in each of them would be written out, and run, in each.
    bare = F.array(F.struct(codes.strip_controls(src).alias("src"), codes.strip_controls(dst).alias("dst")))

    def wrong(a: str, b: str, x: Column) -> Column:
        (given, taken), (here, there) = ([codes.occurrences(x[side], m) for m in (a, b)] for side in ("src", "dst"))
        if a == b:
            return (given >= 2) & (given % 2 == 0) & (here % 2 == 1)
        return (given == taken) & (here > 0) & (there > 0) & (here != there)

    named = lambda x: F.array(*[F.when(wrong(a, b, x), F.lit(a if a == b else a + b)) for a, b in PAIRS])
    return F.filter(F.get(F.transform(bare, named), F.lit(0)), lambda x: x.isNotNull())


def symbol_differences(src: Column, dst: Column) -> Column:
    """Classes of symbols that the two sides have in different numbers."""
    one, other = codes.symbols(src), codes.symbols(dst)
    made = [F.when(F.size(one[k]) != F.size(other[k]), F.lit(k)) for k in one]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def unknown_controls(dst: Column, known: list[str]) -> Column:
    """Backslashes that begin no control code known, with the character after them."""
    found = codes.found(dst, r"\\[A-Za-z]+|\\[^A-Za-z\s]")
    letters = F.filter(found, lambda c: ~c.rlike(f"^(?:{codes.CONTROL})$") & (c != "\\n"))
    named = F.filter(found, lambda c: c.rlike(r"^\\[A-Za-z]+$") & (c != "\\n"))
    return F.array_except(F.array_union(letters, named), F.array(*map(F.lit, known)).cast("array<string>"))


def _letters(x: str | None) -> str:
    """Lower case without white space; control codes are taken off before."""
    return "".join((x or "").lower().split())


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two texts of 8 or more; 0 for shorter ones. Take control codes off first."""
    from difflib import SequenceMatcher

    def one(x: str | None, y: str | None) -> float:
        p, q = _letters(x), _letters(y)
        return SequenceMatcher(None, p, q, autojunk=False).ratio() if min(len(p), len(q)) >= 8 else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a bit for each character of a."""
    at, most = 0, min(len(a), len(b))
    while at < most and a[at] == b[at]:
        at += 1
    end = 0
    while end < most - at and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[at : len(a) - end], b[at : len(b) - end]
    places: dict[str, bytearray] = {}
    for i, c in enumerate(a):
        places.setdefault(c, bytearray(len(a) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    masks = {c: int.from_bytes(x, "little") for c, x in places.items()}
    full = open_ = (1 << len(a)) - 1
    for c in b:
        hit = open_ & masks.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return at + end + len(a) - open_.bit_count()


def _longest_block(a: str, b: str) -> tuple[int, int, int]:
    """Longest common block as SequenceMatcher finds it, first in a, then in b; by a suffix automaton of b."""
    if a == b:
        return 0, 0, len(a)
    # Steps, suffix link, length and first end of each state.
    steps: list[dict[str, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(b):
        new, p = len(steps), last
        steps.append({}), size.append(size[last] + 1), first.append(i), link.append(0)
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q])), size.append(size[p] + 1), first.append(first[q]), link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    best, at, n = (0, 0, 0), 0, 0
    for i, c in enumerate(a):
        while at and c not in steps[at]:
            at = link[at]
            n = size[at]
        if c in steps[at]:
            at = steps[at][c]
            n += 1
            if n > best[2]:
                best = (i - n + 1, first[at] - n + 1, n)
    return best


def ratio_at_least(a: str, b: str, least: float) -> bool:
    """Whether SequenceMatcher's ratio of the whole texts is ``least`` or more; only bounds that can't change that cut work short."""
    total = len(a) + len(b)
    return matches_enough(a, b, lambda n: 2.0 * n / total >= least if total else 1.0 >= least)


def matches_enough(a: str, b: str, fits: Callable[[int], bool]) -> bool:
    """Whether as many characters as SequenceMatcher's blocks of the whole texts have fit; ``fits`` is true from some number on."""
    if not fits(min(len(a), len(b))):
        return False
    if a == b:
        return fits(len(a))
    if not fits((Counter(a) & Counter(b)).total()) or not fits(_common(a, b)):
        return False
    matched, open_, parts = 0, min(len(a), len(b)), [(-min(len(a), len(b)), 0, len(a), 0, len(b))]
    while not fits(matched):
        if not parts or not fits(matched + open_):
            return False
        most, i0, i1, j0, j1 = heappop(parts)
        open_ += most
        i, j, n = _longest_block(a[i0:i1], b[j0:j1])
        matched += n
        for part in ((i0, i0 + i, j0, j0 + j), (i0 + i + n, i1, j0 + j + n, j1)) if n else ():
            if k := min(part[1] - part[0], part[3] - part[2]):
                heappush(parts, (-k, *part))
                open_ += k
    return True


def nearly_same(src: Column, dst: Column, least: float) -> Column:
    """Whether the ratio of matching characters (``sequence_ratio``) is ``least`` or more, for whole texts of any length."""

    @F.pandas_udf(T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        both = ((_letters(x), _letters(y)) for x, y in zip(a, b))
        return pd.Series([ratio_at_least(p, q, least) if min(len(p), len(q)) >= 8 else 0.0 >= least for p, q in both], dtype=bool)

    return run(codes.strip_controls(src), codes.strip_controls(dst))


def checks(white: list[str] | None = None, known_controls: list[str] | None = None) -> dict[str, Column]:
    """Detail of each check of (src, dst), null where there is nothing to report."""
    src, dst = F.col("src"), F.col("dst")
    held = F.regexp_replace(dst, PLACEHOLDER, "")
    listed = lambda x: F.when(F.size(x) > 0, F.array_join(x, ","))
    return {
        "latin": listed(residual_latin(dst, white or [])),
        "symbols": listed(symbol_differences(src, dst)),
        "controls": listed(unknown_controls(dst, known_controls or [])),
        "placeholder": listed(F.regexp_extract_all(dst, F.lit(f"({PLACEHOLDER})"), F.lit(1))),
        "at_signs": listed(F.regexp_extract_all(held, F.lit("(@{2,})"), F.lit(1))),
        "punctuation": listed(unbalanced(src, dst)),
        "echo": F.when(strip(src) == strip(dst), F.lit("same")),
        "empty": F.when(strip(dst) == "", F.lit("empty")),
    }


def untouched_specials(specials: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """(key, line_no, bare): special lines that the output still has as they were, by line number."""
    now = output.select(key, "line_no", strip(F.col("line")).alias("now"))
    return specials.select(key, "line_no", "bare").join(now, [key, "line_no"]).where("bare = now").select(key, "line_no", "bare")


#: Order of the kinds in a report.
KINDS = ("latin", "near_echo", "symbols", "controls", "placeholder", "at_signs", "punctuation", "echo", "empty")


def with_extra(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Findings and those of other checks, each with the place of its kind in the report (other kinds last)."""
    both = hits.unionByName(extra, allowMissingColumns=True)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return both.withColumn("place", F.when(place > 0, place).otherwise(len(KINDS) + 1).cast("int"))


def findings(rows: DataFrame, keys: list[str], details: dict[str, Column]) -> DataFrame:
    """(keys, kind, detail): a row for each check that reports; checks are independent of one another."""
    wide = rows.select(*keys, *[c.alias(f"d_{k}") for k, c in details.items()])
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"d_{k}").alias("detail")) for k in details])
    return wide.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*").where("detail is not null")


def overlay_edits(hits: DataFrame, edits: DataFrame) -> DataFrame:
    """Hits and edits by src: a hit with an edit is marked edited, an edit without a hit is a row of its own."""
    joined = hits.alias("h").join(edits.alias("e"), F.col("h.src") == F.col("e.src"), "full_outer")
    return joined.select(
        F.coalesce("h.src", "e.src").alias("src"),
        F.when(F.col("h.src").isNull(), "edited_only").otherwise(F.col("h.kind")).alias("kind"),
        F.coalesce("e.dst", "h.dst").alias("dst"),
        F.col("e.src").isNotNull().alias("edited"),
    )


def term_report(rows: DataFrame, section: str, key: str, order: str) -> DataFrame:
    """Kinds of term problems: empty, echo, Latin (or a control code) left, symbols only, and another translation than the first of its key.

    The first three exclude one another and all else; sources of a single letter are
    passed over. The first translation of a key (without case and white space at the
    ends) is that of the first row with none of the three.
    """
    src, dst = strip(F.col(key)), strip(F.coalesce("dst", F.lit("")))
    code = r"\\[A-Za-z]\[[^\]]*\]|\\[A-Za-z]"
    kind = (
        F.when(dst == "", "empty")
        .when(dst == src, "echo")
        .when(F.regexp_replace(dst, code, "").rlike(f"[{LATIN}]{{2,}}") | dst.rlike(code), "latin")
    )
    # Fixed value: characters that say nothing by themselves.
    marks = "[\\[\\]{}<>@#~%$^&*_=|/\\\\'\"“”‘’()（）…·・.,;:!?！？，。、；：\\s]"
    own = rows.where(~src.rlike(r"^\p{L}$")).withColumns({"kind": kind, "key_": F.lower(src), "bare_": dst})
    sound = own.where("kind is null")
    bare = sound.withColumn("kind", F.when(F.regexp_replace("bare_", marks, "") == "", "symbols")).where("kind is not null")
    first = sound.groupBy(section, "key_").agg(F.min_by("bare_", order).alias("first_"))
    other = sound.join(first, [section, "key_"]).where("bare_ <> first_").withColumn("kind", F.lit("inconsistent"))
    out = own.where("kind is not null").unionByName(bare).unionByName(other.select(own.columns))
    return out.drop("key_", "bare_")
