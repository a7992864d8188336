"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names the control strings, the roles whose text is trained on, and the machine:
``moves[state][role]`` is the next state, missing moves lead to ``REJECT``. Texts escape the
control strings with a backslash, reversibly; role names are percent-encoded.

Conversations are cut into chunks of turns. A chunk formats its turns and reduces the machine
to a table "state before -> state after"; a conversation only joins its chunks in order. So a
conversation that holds a large part of all rows is formatted by many tasks, and only the
finished strings meet in its row. Column functions only.

Cases: null text and null role are empty strings; turns without a number come last; rows of
the same turn follow by role and text; a null conversation id is a conversation of its own;
a machine that rejects sets ``valid`` to false and the turns are formatted all the same; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import columns_of

CHUNK_BITS = 8  # 256 turn numbers to a chunk
LAST = (1 << 63) - 1
REJECT = "reject"


@dataclass(frozen=True)
class Template:
    head: str = "### "
    after_role: str = "\n"
    end: str = "\n</turn>\n"
    controls: tuple[str, ...] = ("### ", "</turn>")
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })

    @property
    def states(self) -> list[str]:
        ends = {to for row in self.moves.values() for to in row.values()}
        return sorted({self.start, REJECT, *self.moves, *ends})


DEFAULT = Template()


def _any_of(controls: tuple[str, ...]) -> str:
    return "|".join([r"\\", *[f"\\Q{c}\\E" for c in controls]])


def escape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, f"({_any_of(template.controls)})", r"\\$1")


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, rf"\\({_any_of(template.controls)})", "$1")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _step(state: Column, role: Column, template: Template) -> Column:
    table = F.create_map(*[F.lit(x) for s, row in template.moves.items() for r, to in row.items() for x in (f"{s} {r}", to)])
    return F.coalesce(F.element_at(table, F.concat_ws(" ", state, role)), F.lit(REJECT))


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, valid, segments array<struct<text, loss>>: one row per conversation."""
    number = F.coalesce(F.col("turn").cast("long"), F.lit(LAST))
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    no = F.lit(False)
    rows = columns_of(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", F.shiftright(number, CHUNK_BITS).alias("chunk"),
        F.struct(
            number.alias("turn"), role.alias("role"), text.alias("raw"),
            F.array(
                _segment(F.concat(F.lit(template.head), F.url_encode(role), F.lit(template.after_role)), no),
                _segment(escape(text, template), role.isin(*template.trained)),
                _segment(F.lit(template.end), no),
            ).alias("segments"),
        ).alias("item"),
    )
    states = F.array(*[F.lit(s) for s in template.states])
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("item")).alias("items")).select(
        "conv_id",
        F.struct(
            "chunk",
            F.transform(states, lambda s: F.aggregate("items", s, lambda at, item: _step(at, item["role"], template))).alias("ends"),
            F.flatten(F.transform("items", lambda item: item["segments"])).alias("segments"),
        ).alias("part"),
    )
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list("part"), lambda a, b: (
        F.when(a["chunk"] < b["chunk"], -1).when(a["chunk"] > b["chunk"], 1).otherwise(0)
    )).alias("parts"))
    end = F.aggregate(
        "parts", F.lit(template.start), lambda at, part: F.element_at(part["ends"], F.array_position(states, at).cast("int"))
    )
    return whole.select(
        "conv_id", end.isin(*template.accept).alias("valid"),
        F.flatten(F.transform("parts", lambda part: part["segments"])).alias("segments"),
    )


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """array<struct<role, text>> parsed from one formatted string."""
    pieces = F.filter(F.split(formatted, f"\\Q{template.end}\\E", -1), lambda p: p != "")
    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, template.after_role, 1)
        return F.struct(
            F.url_decode(F.substr(head, F.lit(len(template.head) + 1))).alias("role"),
            unescape(F.substr(piece, F.length(head) + len(template.after_role) + 1), template).alias("text"),
        )
    return F.transform(pieces, turn)


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(length(url_encode(role)) + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) + 14) as bigint) formatted_chars,
  coalesce(regexp_matches(string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'x' end,
    '' order by turn nulls last, role, text), '^s?(ua)+$'), false) "valid"
from t group by conv_id
"""
