"""Operator 9: chat formatting from event logs.

A log row is (conversation, message, sequence, kind, role, text). Kinds: `delta` appends to the message, `edit` replaces
its text, `regenerate` empties it for deltas to come, `delete` takes it away. Rows are dealt by conversation and message,
so a conversation that holds a third of all rows is folded by many tasks; messages are then sorted within conversations
and rendered as a stream: no task holds a conversation whole. A conversation's digest reads its turns in order, so its rows
pass through one task of `read_back`, which holds the digest's state and one batch.

Template: each turn is ``<s>[role]`` + role + ``[/role]`` + text + ``</s>`` in escaped form. A ``\\`` in a role or text
becomes ``\\\\`` and each ``<``, ``>``, ``[`` or ``]`` becomes ``\\`` and one of ``lgoc``, so that no text holds a control string and
`unescape` gives it back. The loss mask covers the texts of assistant turns.

Defined cases: null text is empty; a null role is the empty role; events are applied by sequence, at ties by kind, role and
text; messages go by number, null first, repeated rows are messages of their own in `turns_as_events`; deltas to a
deleted message begin it anew; a null conversation is a conversation; an empty table gives an empty result; a very long
text is held whole by the task of its message alone; columns other than those named are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TO = {"\\": "\\\\", "<": "\\l", ">": "\\g", "[": "\\o", "]": "\\c"}
_FROM = {v: k for k, v in _TO.items()}
_SPECIAL = re.compile(r"[\\<>\[\]]")
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_TURN = re.compile(r"<s>\[role\](.*?)\[/role\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: _TO[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _FROM[m[0]], text)


def render_turn(role: str, text: str) -> str:
    return f"<s>[role]{escape(role)}[/role]{escape(text)}</s>"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of rendered text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, message, seq, kind, role, text).

    Only what stands from the last edit, regeneration or deletion of a message counts; its deltas are joined in order.
    """
    log = events.select("conv_id", "message", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = log.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("e"))
    resets = F.transform("e", lambda x, i: F.when(x["kind"] != "delta", i))
    start = grouped.withColumn("s", F.coalesce(F.array_max(resets), F.lit(-1)))
    rest = F.filter("e", lambda x, i: i >= F.greatest(F.col("s"), F.lit(0)))
    final = start.withColumns({"dead": F.when(F.col("s") >= 0, F.get("e", F.col("s"))["kind"] == "delete").otherwise(False), "r": rest})
    text = F.array_join(F.transform("r", lambda x: F.when(x["kind"].isin("delta", "edit"), x["text"]).otherwise("")), "")
    return final.where(~F.col("dead") | (F.size("r") > 1)).select("conv_id", "message", F.element_at("e", -1)["role"].alias("role"), text.alias("text"))


#: Code points of a streamed delta.
PIECE = 200


def turns_as_events(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The log by which each turn comes to its text, as chat services write it: deltas of at most `piece` code points,
    and, by a hash of the message, none or one of these before: a draft that an edit replaces whole or in its first
    piece, that is regenerated, or that is deleted and begun anew. `fold` gives the turns back. Rows of equal
    (conversation, turn) are messages of their own."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    again = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    rows = rows.withColumn("again", again).withColumns(
        {
            "pieces": F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut),
            "way": F.pmod(F.xxhash64("conv_id", "turn", "again"), F.lit(5)),
        }
    )

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    deltas = F.transform("pieces", lambda p: event("delta", p))
    first = F.element_at("pieces", 1)
    draft = event("delta", F.reverse(first))
    log = (
        F.when(F.col("way") == 0, F.array(draft, event("edit", F.col("text"))))
        .when(F.col("way") == 1, F.concat(F.array(draft, event("edit", first)), F.slice(deltas, 2, F.size("pieces"))))
        .when(F.col("way") == 2, F.concat(F.array(draft, event("regenerate", F.lit(""))), deltas))
        .when(F.col("way") == 3, F.concat(F.array(draft, event("delete", F.lit(""))), deltas))
        .otherwise(deltas)
    )
    message = F.struct("turn", "again").alias("message")
    events = rows.select("conv_id", message, "role", F.posexplode(log).alias("seq", "event"))
    return events.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "event.kind", "role", "event.text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, message, formatted): each final message as its turn of the template."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["formatted"] = [render_turn(r, t) for r, t in zip(pdf["role"], pdf["text"])]
            yield pdf[["conv_id", "turn", "again", "formatted"]]

    flat = messages.select("conv_id", "message.turn", "message.again", "role", "text")
    return flat.mapInPandas(run, "conv_id long, turn long, again int, formatted string")


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation from its rendered turns, which pass in order and are not held."""
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "again")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for conv, text in zip(pdf["conv_id"].astype(object), pdf["formatted"]):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != key:
                    if state is not None:
                        out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(text)
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        state[2] += len(said)
                        state[3].update(said.encode("utf-8", "surrogatepass"))
            if out:
                yield _digests(out)
        if state is not None:
            yield _digests([(key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])])

    return ordered.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.astype({"conv_id": "Int64"})


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, message, formatted) of every turn of the table."""
    return render(fold(turns_as_events(conversations)))
