"""Queries on event commands, made of the sentences of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import event_commands
from .registry import query

_CODES = (101, 401, 401, 102, 355, 111, 209, 0, 101, 401)


def _commands(t):
    """A list for each document: its sentences are commands, of a code by their length."""
    rows = t("documents").select("lang", "doc_id", F.posexplode(F.split("text", r"[.\n]")).alias("place", "text"))
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.length("text") % 10 + 1).cast("int"))
    script = F.concat(F.lit('pb(_I("'), F.replace("text", F.lit(","), F.lit('\\"')), F.lit('"), _I ( "'), F.substring("text", 3, 9), F.lit('"))'))
    rows = rows.withColumns({"code": code, "said": F.replace("text", F.lit(" "), F.lit("  ")), "script": script})
    return rows.select(
        F.col("lang").alias("map"),
        F.col("doc_id").alias("event"),
        F.lit(0).alias("page"),
        "place",
        "code",
        F.when(F.col("code").isin(355, 111), F.col("script")).otherwise(F.col("said")).alias("text"),
        (F.length("text") % 4 + 10).alias("number"),
        F.split("text", ",").alias("texts"),
        F.array(F.struct(F.lit(45).alias("code"), F.col("script").alias("text")), F.struct(F.lit(44).alias("code"), F.col("script").alias("text"))).alias("route"),
    )


_PATTERN = r"""_I\s*\(\s*"((?:[^\\"]*\\"?)*[^"]*)["]"""
_SQL = rf"""
WITH said AS (
  SELECT lang, doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS place FROM (SELECT *, regexp_split_to_array(text, '[.\n]') AS parts FROM documents)
), c AS (
  SELECT *, [{", ".join(map(str, _CODES))}][length(text) % 10 + 1] AS code, length(text) % 4 + 10 AS number,
    'pb(_I("' || replace(text, ',', '\"') || '"), _I ( "' || substr(text, 3, 9) || '"))' AS script, max(place) OVER (PARTITION BY doc_id) AS list_end
  FROM said
), islands AS (
  SELECT *, code IN (101, 401) AS talk, lag(code) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM c
), runs AS (
  SELECT *, sum(CASE WHEN code = 101 OR code = 401 AND coalesce(before NOT IN (101, 401), true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM islands
), joined AS (
  SELECT lang, doc_id, min(place) AS place, max(place) = any_value(list_end) AS last,
    ltrim(string_agg(CASE WHEN text = '' THEN '' ELSE replace(text, ' ', '  ') END, chr(1) ORDER BY place), chr(1)) AS text
  FROM runs WHERE talk GROUP BY lang, doc_id, run
), items AS (
  SELECT lang, doc_id, place, 0 AS nth, CASE WHEN last THEN replace(text, chr(1), ' ') ELSE regexp_replace(replace(text, chr(1), ' '), '([^.!?])\s\s+', '\1 ', 'g') END AS text FROM joined WHERE text != ''
  UNION ALL
  SELECT lang, doc_id, place, generate_subscripts(found, 1) - 1, replace(replace(unnest(found), '\"', '"'), '\\', '\')
  FROM (SELECT *, regexp_extract_all(script, '{_PATTERN}', 1) AS found FROM c WHERE code IN (355, 209) OR code = 111 AND number = 12)
), every AS (
  SELECT lang, text, {{'choice': 0, 'event': doc_id, 'place': place, 'nth': nth}} AS o FROM items
  UNION ALL
  SELECT lang, unnest(string_split(text, ',')), {{'choice': 1, 'event': doc_id, 'place': place, 'nth': generate_subscripts(string_split(text, ','), 1) - 1}} FROM c WHERE code = 102
), first AS (SELECT lang, text, min(o) AS o FROM every GROUP BY lang, text)
SELECT lang AS map, text, o.choice AS choice, o.event AS event, o.place AS place, o.nth AS nth FROM first
"""


@query(_SQL)
def event_command_texts(t):
    """Distinct messages, literals and choices of each map's event lists, in order."""
    return event_commands.event_texts(_commands(t)).drop("page")


_PROGRAMS = r"""
SELECT doc_id, replace(replace(replace(replace(replace(src, '\r', chr(13)), '\n', chr(10)), '\1', chr(1)), '\"', '"'), '\\', '\') AS src, min(place) - 1 AS first
FROM (
  SELECT doc_id, unnest(found) AS src, generate_subscripts(found, 1) AS place
  FROM (
    SELECT doc_id, regexp_extract_all('x=_INTL("' || replace(text, chr(10), '\n') || '") ; _ISPRINTF (  "' || substr(text, 1, 5) || '\1", a) _INTL(b)',
      '(?:_INTL|_ISPRINTF)\s*\(\s*"((?:[^\\"]*\\"?)*[^"]*)"', 1) AS found
    FROM documents
  )
) GROUP BY doc_id, src
"""


@query(_PROGRAMS)
def program_script_texts(t):
    """Distinct literals of program scripts, escapes undone."""
    script = F.concat(F.lit('x=_INTL("'), F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit('") ; _ISPRINTF (  "'), F.substring("text", 1, 5), F.lit('\\1", a) _INTL(b)'))
    return event_commands.program_texts(t("documents").select("doc_id", script.alias("text")), "doc_id")
