"""The query that damages conversations and repairs them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.llm import repair
from tipweave.llm.queries.registry import query
from tipweave.llm.tables import marked, stored, table

NOTHING = hashlib.sha256(b"").hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated and renamed, as the CRC-32 of id and turn decides."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    what = F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id", "turn",
        F.when(what == 4, "user").otherwise(role).alias("role"),
        F.when(what == 1, "").when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
        .alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(what == 0, 0).when(what == 3, 2).otherwise(1)))
        .alias("copy"),
    ).drop("copy")


def _plus(best: str, cost: str, edit: str) -> str:
    return (f"CASE WHEN {best} = '~' THEN '~' ELSE lpad(CAST(CAST({best}[1:8] AS INTEGER) + {cost}"
            f" AS VARCHAR), 8, '0') || {best}[9:] || '{edit}' END")


def _kept(state: int, initial: str, *before: int) -> str:
    came = f"least({', '.join(f'p.best[{x}]' for x in before)})"
    fit = f"t.i = '{initial}' AND t.f NOT IN ('blank', 'duplicate')"
    return f"CASE WHEN {fit} THEN {_plus(came, CUT, 'K')} ELSE '~' END"


def _renamed(*before: int) -> str:
    came = f"least({', '.join(f'p.best[{x}]' for x in before)})"
    return f"CASE WHEN t.f IN ('blank', 'duplicate') THEN '~' ELSE {_plus(came, '2 + ' + CUT, 'R')} END"


CUT = "CASE t.f WHEN 'truncated' THEN 1 ELSE 0 END"
START = "['00000000', '~', '00000002I', '00000004II']"
_DROP = [_plus(f"p.best[{s}]", "3", "D") for s in (1, 2, 3, 4)]
_ROW = (
    f"[{_DROP[0]}, least({_DROP[1]}, {_kept(2, 's', 1)}),"
    f" least({_DROP[2]}, {_kept(3, 'u', 1, 2, 4)}, {_renamed(1, 2, 4)}),"
    f" least({_DROP[3]}, {_kept(4, 'a', 3)}, {_renamed(3)})]"
)
#: A turn made up after each state, twice in a row.
_ONCE = (
    f"[b[1], b[2], least(b[3], {_plus('least(b[1], b[2], b[4])', '2', 'I')}),"
    f" least(b[4], {_plus('b[3]', '2', 'I')})]"
)
PUT_IN = f"list_transform(list_transform([{_ROW}], lambda b: {_ONCE}), lambda b: {_ONCE})[1]"

REPAIR_SQL = rf"""
WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
        lambda c: ord(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda x, bit: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, xor(crc, 4294967295) % 20 AS what FROM keyed)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)
    AS place FROM damaged),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial,
    lag(CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END)
      OVER (PARTITION BY conv_id ORDER BY place) AS earlier
  FROM placed),
talks AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated,
    count_if(earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'i': initial, 'f': fault, 'role': role, 'text': text}} ORDER BY place) AS turns
  FROM marked GROUP BY conv_id),
-- Per state: cost in eight digits and the edits so far; the least of each is carried on.
steps AS (
  SELECT *, list_reduce(list_prepend({{'i': '', 'f': '', 'best': {START}}},
      list_transform(turns, lambda t: {{'i': t.i, 'f': t.f, 'best': CAST([] AS VARCHAR[])}})),
    lambda p, t: {{'i': '', 'f': '', 'best': {PUT_IN}}}).best AS best
  FROM talks),
audited AS (
  SELECT *, CAST(least(best[1], best[4])[1:8] AS BIGINT) AS cost, least(best[1], best[4])[9:] AS audit
  FROM steps),
repaired AS (
  SELECT *, list_reduce(list_prepend({{'e': '', 'at': 0::BIGINT, 's': '', 'said': CAST([] AS VARCHAR[])}},
      list_transform(string_split(audit, ''),
        lambda e: {{'e': e, 'at': 0::BIGINT, 's': '', 'said': CAST([] AS VARCHAR[])}})),
    lambda p, x: {{'e': '', 'at': p.at + CASE x.e WHEN 'I' THEN 0 ELSE 1 END,
      's': CASE x.e WHEN 'D' THEN p.s WHEN 'K' THEN turns[p.at + 1].i
        ELSE CASE p.s WHEN 'u' THEN 'a' ELSE 'u' END END,
      'said': CASE x.e WHEN 'D' THEN p.said
        WHEN 'K' THEN list_append(p.said, turns[p.at + 1].role || ':' || turns[p.at + 1].text)
        ELSE list_append(p.said, CASE p.s WHEN 'u' THEN 'assistant:' ELSE 'user:' END
          || CASE x.e WHEN 'R' THEN turns[p.at + 1].text ELSE '' END) END}}).said AS said
  FROM audited WHERE audit <> '')
SELECT o.conv_id, coalesce(a.gaps, 0) AS gaps, coalesce(a.blank, 0) AS blank,
  coalesce(a.duplicate, 0) AS duplicate, coalesce(a.truncated, 0) AS truncated,
  coalesce(a.illegal, 0) AS illegal, coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit,
  sha256(coalesce(array_to_string(r.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN audited a ON o.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""


@query("op13_repair", REPAIR_SQL)
def repaired(spark, folder):
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns, tallies = repair.repaired(damaged(talks))
    done = stored(tallies, "tallies").join(repair.text_hashes(turns), "talk", "left")
    ids = talks.select("conv_id").distinct().withColumn("talk", marked("conv_id"))
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(done, "talk", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in longs],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"),
    )
