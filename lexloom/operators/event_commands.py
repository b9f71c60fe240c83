"""Texts of event commands: an automaton over ordered rows, as windows over runs.

A command list belongs to (map, event, page) and is ordered by ``place``. One kind of
command starts a message, one continues it, any other ends it; choices are gathered
apart; scripts, script branches and script steps of move routes give the literals that
they look up. Columns of a command: map, event, page, place, code, text (its first
text), number (the kind of a branch), texts (choices) and route, an array of
struct<code, text>.

A list may hold any share of all rows: what comes before a row is found from counts of
blocks of places, so windows run within a block. Null texts count as empty. Places must
be distinct within a list. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Codes of commands, the branch and the route step that hold a script.
START, CONTINUE, CHOICES, BRANCH, ROUTE, SCRIPT, MORE_SCRIPT = 101, 401, 102, 111, 209, 355, 655
SCRIPT_BRANCH, SCRIPT_STEP = 12, 45
#: Literals that event scripts and program scripts look up.
EVENT_LITERAL = r'_I\s*\(\s*"((?:[^\\"]*\\"?)*[^"]*)"'
PROGRAM_LITERAL = r'(?:_INTL|_ISPRINTF)\s*\(\s*"((?:[^\\"]*\\"?)*[^"]*)"'
#: Escapes of a literal, in the order in which they are undone.
EVENT_ESCAPES = (('\\"', '"'), ("\\\\", "\\"))
PROGRAM_ESCAPES = (("\\r", "\r"), ("\\n", "\n"), ("\\1", "\x01"), *EVENT_ESCAPES)
#: Places of a list that are one window.
BLOCK = 4096
LIST = ("map", "event", "page")


def literals(script: Column, pattern: str = EVENT_LITERAL, escapes: tuple = EVENT_ESCAPES) -> Column:
    """Array of the literals of a script, escapes undone."""

    def plain(x: Column) -> Column:
        for escaped, own in escapes:
            x = F.replace(x, F.lit(escaped), F.lit(own))
        return x

    return F.transform(F.regexp_extract_all(F.coalesce(script, F.lit("")), F.lit(pattern), F.lit(1)), plain)


def program_texts(scripts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, src, first): distinct literals of each program script and the place of the first of each."""
    found = scripts.select(key, F.posexplode(literals(F.col(text), PROGRAM_LITERAL, PROGRAM_ESCAPES)).alias("place", "src"))
    return found.groupBy(key, "src").agg(F.min("place").alias("first"))


def _with_runs(commands: DataFrame) -> DataFrame:
    """The starts and continuations, with run (a number within the list) and list_end (the list's last place)."""
    said = F.col("code").isin(START, CONTINUE)
    rows = commands.select(*LIST, "place", "code", "text", F.floor(F.col("place") / BLOCK).alias("block"))
    # A continuation starts a message where none is open; the first row of a block may be one.
    within = Window.partitionBy(*LIST, "block").orderBy("place")
    before = F.lag(said).over(within)
    blocks = rows.withColumn("open", before).groupBy(*LIST, "block").agg(
        F.count(F.when((F.col("code") == START) | ((F.col("code") == CONTINUE) & ~F.col("open")), 1)).alias("starts"),
        F.min_by("code", "place").alias("first_code"),
        F.max_by("code", "place").alias("last_code"),
        F.max("place").alias("last_place"),
    )
    by_block = Window.partitionBy(*LIST).orderBy("block")
    open_before = F.coalesce(F.lag("last_code").over(by_block).isin(START, CONTINUE), F.lit(False))
    blocks = blocks.withColumn("open_before", open_before)
    starts = F.col("starts") + F.when((F.col("first_code") == CONTINUE) & ~F.col("open_before"), 1).otherwise(0)
    blocks = blocks.withColumns(
        {
            "starts_before": F.coalesce(F.sum(starts).over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "list_end": F.max("last_place").over(Window.partitionBy(*LIST)),
        }
    ).select(*LIST, "block", "open_before", "starts_before", "list_end")
    rows = rows.join(blocks, [*LIST, "block"])
    is_open = F.coalesce(F.lag(said).over(within), F.col("open_before"))
    start = (F.col("code") == START) | ((F.col("code") == CONTINUE) & ~is_open)
    run = F.col("starts_before") + F.count(F.when(start, 1)).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).where(said)


def messages(commands: DataFrame) -> DataFrame:
    """(map, event, page, place, text) of each message that isn't empty, place being its first row's.

    Texts of a run are joined by spaces from the first that isn't empty on. Where another
    command ends the message, two or more white spaces after anything but .!? become one;
    a message that ends its list stays as it is.
    """
    runs = _with_runs(commands).groupBy(*LIST, "run", "list_end")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    made = runs.agg(F.min("place").alias("place"), F.max("place").alias("last"), texts.alias("texts"))
    first = F.array_position(F.transform("texts", lambda x: x != ""), True)
    joined = F.when(first > 0, F.array_join(F.slice("texts", first.cast("int"), F.size("texts")), " "))
    made = made.withColumn("text", joined).where(F.col("text").isNotNull())
    cleaned = F.regexp_replace("text", r"([^.!?])\s\s+", "$1 ")
    return made.select(*LIST, "place", F.when(F.col("last") == F.col("list_end"), F.col("text")).otherwise(cleaned).alias("text"))


def script_texts(commands: DataFrame) -> DataFrame:
    """(map, event, page, place, nth, text) of each literal of the scripts in the commands."""
    code = F.col("code")
    steps = F.filter(F.coalesce("route", F.array()), lambda x: x["code"] == SCRIPT_STEP)
    of_route = F.flatten(F.transform(steps, lambda x: literals(x["text"])))
    script = code.isin(SCRIPT, MORE_SCRIPT) | ((code == BRANCH) & (F.col("number") == SCRIPT_BRANCH))
    found = F.when(script, literals(F.col("text"))).when(code == ROUTE, of_route)
    return commands.where(code.isin(SCRIPT, MORE_SCRIPT, BRANCH, ROUTE)).select(*LIST, "place", F.posexplode(found).alias("nth", "text"))


def event_texts(commands: DataFrame) -> DataFrame:
    """(map, text, choice, event, page, place, nth): the distinct texts of each map; all but text and map give their order.

    Messages and literals come before choices (choice 0 and 1), each text once, at its
    first place; a choice that is a message too is there as a message.
    """
    order = ("choice", "event", "page", "place", "nth")
    said = messages(commands).select("map", F.lit(0).alias("choice"), "event", "page", "place", F.lit(0).alias("nth"), "text")
    scripts = script_texts(commands).select("map", F.lit(0).alias("choice"), "event", "page", "place", "nth", "text")
    choices = commands.where(F.col("code") == CHOICES).select("map", F.lit(1).alias("choice"), "event", "page", "place", F.posexplode("texts").alias("nth", "text"))
    every = said.unionByName(scripts).unionByName(choices.where(F.col("text").isNotNull()))
    return every.groupBy("map", "text").agg(F.min(F.struct(*order)).alias("first")).select("map", "text", "first.*")
