"""Conversations as training text with a loss mask, in Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role become one
message of several parts; messages are concatenated by a template. No Python runs on any row.

A template marks where messages, role names, further parts and ends are. Control strings inside
texts and roles (the template's own and those it also guards) are escaped by one backslash after
their first character; where backslashes stand there already, one is added, so that removing
one gives the text back. Control strings start with ``<`` or ``[`` and have neither these nor a
backslash further on, so no escape can build or hide another one.

The result is read back by splitting at the marks. The loss mask is kept in two forms: ``segments``,
whose texts give ``formatted`` when put together and of which ``train`` ones are learned, and
``loss_spans``, their code point offsets.

Rows are put in order by turn (null first), then role, then text (as escaped), so ties and repeated
rows have one order; all of them stay. Null role and null text are empty. Rows without conv_id are one
conversation of their own. An empty table gives an empty result. Extra columns don't travel.

Escaping runs on the rows as they are read. One conversation is one cell of the result, whatever its length: that is
what is asked for, so a conversation is sorted in one task and Spark's cell bound of 2 GB holds for it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a public chat format, and control strings of other formats that texts must not hold either."""

    start: str = "<|im_start|>"
    head_end: str = "<|im_sep|>"
    joint: str = "<|im_part|>"
    end: str = "<|im_end|>"
    guarded: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")

    def __post_init__(self) -> None:
        marks = [getattr(self, f.name) for f in fields(self) if f.name != "guarded"]
        if len(set(marks)) < len(marks):
            raise ValueError("marks of a template must differ")
        for control in self.controls:
            if not re.fullmatch(r"[<\[][^<\[\\]+", control):
                raise ValueError(f"control string {control!r} must start with < or [ and hold no <, [ or backslash after that")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.head_end, self.joint, self.end, *self.guarded)

    @property
    def pattern(self) -> str:
        """Opener, backslashes and rest of a control string, as three groups."""
        tails = "|".join(re.sub(r"([^0-9A-Za-z])", r"\\\1", c[1:]) for c in sorted(self.controls, key=lambda c: (-len(c), c)))
        return rf"([<\[])(\\*)({tails})"


DEFAULT = Template()


def escaped(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, template.pattern, r"$1\\$2$3")


def unescaped(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, template.pattern.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _segments(turns: Column, before: Column, after: Column, template: Template, learned: tuple[str, ...]) -> Column:
    """Marks and texts in order; ``before`` and ``after`` hold the neighbours' roles (null at the ends)."""
    def piece(text: Column, train: Column) -> Column:
        return F.struct(text.alias("text"), train.alias("train"))

    def of(turn: Column, role: Column, roles: Column) -> Column:
        opens = role.isNull() | (role != turn["role"])
        closes = roles.isNull() | (roles != turn["role"])
        head = F.when(opens, F.concat(F.lit(template.start), turn["role"], F.lit(template.head_end))).otherwise(F.lit(template.joint))
        tail = F.when(closes, F.lit(template.end)).otherwise(F.lit(""))
        return F.array(piece(head, F.lit(False)), piece(turn["text"], turn["role"].isin(*learned)), piece(tail, F.lit(False)))

    near = F.arrays_zip(turns.alias("turn"), before.alias("before"), after.alias("after"))
    return F.flatten(F.transform(near, lambda x: of(x["turn"], x["before"], x["after"])))


def formatted(turns: DataFrame, template: Template = DEFAULT, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, segments array<struct<text, train>> and formatted, one row per conversation."""
    def clean(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(
        F.col(f"`{turn}`").alias("turn"), escaped(clean(role), template).alias("role"), escaped(clean(text), template).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    convs = convs.withColumn("roles", F.transform("turns", lambda t: t["role"]))
    none = F.array(F.lit(None).cast("string"))
    n = F.size("roles")
    convs = convs.select("conv_id", "turns", F.concat(none, F.slice("roles", 1, n - 1)).alias("before"), F.concat(F.slice("roles", 2, n), none).alias("after"))
    mine = tuple(_escape_literal(r, template) for r in learned)
    convs = convs.select("conv_id", _segments(F.col("turns"), F.col("before"), F.col("after"), template, mine).alias("segments"))
    return convs.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _escape_literal(text: str, template: Template) -> str:
    return re.sub(template.pattern, r"\1\\\2\3", text)


def loss_spans(convs: DataFrame) -> DataFrame:
    """One row per learned text: conv_id, start and end (code points of ``formatted``, end exclusive).

    A running sum over the segments of a conversation, as a window, so that nothing is copied per step.
    """
    parts = convs.select("conv_id", F.posexplode("segments").alias("at", "s"))
    until = F.sum(F.length("s.text")).over(Window.partitionBy("conv_id").orderBy("at"))
    spans = parts.select("conv_id", F.col("s.train").alias("train"), until.cast("long").alias("end"), F.length("s.text").alias("n"))
    return spans.where("train").select("conv_id", (F.col("end") - F.col("n")).cast("long").alias("start"), "end")


def _pieces(text: Column, mark: str) -> Column:
    return F.split(text, re.sub(r"([^0-9A-Za-z])", r"\\\1", mark), -1)


def _messages(template: Template) -> Column:
    def message(body: Column) -> Column:
        head = F.substring_index(body, template.head_end, 1)
        rest = F.substr(body, F.length(head) + F.lit(len(template.head_end) + 1))
        return F.struct(unescaped(F.substr(head, F.lit(len(template.start) + 1)), template).alias("role"),
                        F.transform(_pieces(rest, template.joint), lambda p: unescaped(p, template)).alias("parts"))

    return F.transform(F.filter(_pieces(F.col("formatted"), template.end), lambda m: m != ""), message)


def parsed(convs: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, messages array<struct<role, parts>> as ``formatted`` says, unescaped."""
    return convs.select("conv_id", _messages(template).alias("messages"))


def report(convs: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Counts and digests, read back from the formatted text and its loss mask."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["train"]), lambda s: unescaped(s["text"], template)), "")
    out = convs.select("conv_id", "formatted", loss.alias("loss"), _messages(template).alias("messages"))
    turns = F.flatten(F.transform("messages", lambda m: F.transform(m["parts"], lambda p: F.concat(m["role"], F.lit("\n"), p, F.lit("\n")))))
    out = out.select("conv_id", "formatted", "loss", F.size("messages").alias("n_messages"), turns.alias("turns"))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), F.col("n_messages").cast("long").alias("n_messages"))


#: conversation -7 of the query
PROBE = "</s>[INST] ok [/INST]"


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The four columns of ``turns`` and conversation -7, whose texts look like control strings."""
    rows = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)


def _sql_pattern(template: Template) -> str:
    return template.pattern.replace("'", "''")


#: The report, with the template's rules written a second time.
REPORT_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))),
safe AS (
  SELECT *, regexp_replace(role, '{_sql_pattern(DEFAULT)}', '\\1\\\\\\2\\3', 'g') AS safe_role,
    regexp_replace(text, '{_sql_pattern(DEFAULT)}', '\\1\\\\\\2\\3', 'g') AS safe_text FROM given),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, safe_role, safe_text) AS pos FROM safe),
near AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY pos) = role, false) AS goes_on FROM placed)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe_text) + CASE WHEN goes_on THEN {len(DEFAULT.joint)}
    ELSE length(safe_role) + {len(DEFAULT.start) + len(DEFAULT.head_end) + len(DEFAULT.end)} END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (NOT goes_on) AS n_messages
FROM near GROUP BY conv_id"""
