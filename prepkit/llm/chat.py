"""Operator 3: chat formatting with a grammar round trip.

The grammar of formatted text (a conversation is its turns, one after another):

    turn   := "<s>[INST] " body " [/INST]"                 user
            | " " body " </s>"                             assistant
            | "<<SYS>>\\n" body "\\n<</SYS>>\\n"              system
            | "[ROLE " name "] " body " [/ROLE]"           any other role, percent-encoded

A control string inside a body stands behind an odd number of backslashes:
escaping doubles the backslashes before it and adds one.  Rendering tries the
plain text first and reparses it; where the recovered turn differs from the
source, it escapes and reparses again.

Turns are rendered where they lie.  Reading back needs a conversation's turns
in order (its digests are sequential), so rows are shuffled by conversation,
sorted in the partition by Spark, and streamed through an incremental parser
that holds one turn at a time, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from prepkit.session import ship_package

#: The control strings of the template.
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE"
#: How a role's turn opens and closes.
TURNS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}

_ESCAPE = re.compile(rf"(\\*)({CONTROL})")
_STOP = re.compile(rf"(?<!\\)(?:\\\\)*({CONTROL})")
_ROLE = re.compile(r"\[ROLE ([^\] ]*)\] ")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[1]}{m[1]}\\{m[2]}", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1][:len(m[1]) // 2] + m[2], text)


class Parser:
    """Recovers turns from formatted text that arrives in pieces."""

    def __init__(self) -> None:
        self.left = ""

    def _unsure(self) -> bool:
        """What is there may still become the opening of a turn."""
        role = self.left.startswith("[ROLE ") and "] " not in self.left
        return role or any(o.startswith(self.left) for o in ("[ROLE ", *(a for a, _ in TURNS.values())))

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, first and last code point of the escaped body in what this
        turn spans) of each turn that is complete."""
        self.left += piece
        while self.left:
            opened = next(((r, a, z) for r, (a, z) in TURNS.items() if self.left.startswith(a)), None)
            if opened:
                role, begin, close = opened
                start = len(begin)
            elif m := _ROLE.match(self.left):
                role, start, close = unquote(m[1]), m.end(), " [/ROLE]"
            elif self._unsure():
                return
            else:
                raise ValueError(f"no turn begins here: {self.left[:40]!r}")
            stop = _STOP.search(self.left, start)
            if not stop:
                return
            at = stop.start(1)
            lead = close.index(close.strip())
            body_end, end = at - lead, at - lead + len(close)
            if end > len(self.left) and close.startswith(self.left[body_end:]):
                return
            if body_end < start or self.left[body_end:end] != close:
                raise ValueError(f"a stray control string in a turn of {role!r}: {self.left[at:at + 10]!r}")
            yield role, unescape(self.left[start:body_end]), start, body_end
            self.left = self.left[end:]


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its body is, escaped only if it must be."""
    begin, close = TURNS.get(role) or (f"[ROLE {quote(role, safe='')}] ", " [/ROLE]")
    for body in (text, escape(text)):
        whole, parser = begin + body + close, Parser()
        try:
            back = list(parser.feed(whole))
        except ValueError:
            continue
        if not parser.left and [x[:2] for x in back] == [(role, text)]:
            return whole, len(begin), len(begin) + len(body)
    raise AssertionError(f"a turn of {role!r} does not survive the round trip")


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """A row per input row: conv, turn, role, text, ``formatted``, and
    ``loss_start``/``loss_end``, the code points of ``formatted`` under the loss
    mask (an assistant's body; NULL for other roles).

    NULL texts and roles are empty strings.  Repeated rows stay and are repeated
    turns.  Other columns are dropped; an empty table gives no rows.
    """
    ship_package(df.sparkSession)
    conv, turn = df.schema[conv_col].dataType.simpleString(), df.schema[turn_col].dataType.simpleString()
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                     F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            made = [render(r, t) for r, t in zip(b["role"], b["text"])]
            spoken = b["role"] == "assistant"
            yield b.assign(formatted=[m[0] for m in made],
                           loss_start=pd.array([m[1] if s else None for m, s in zip(made, spoken)], dtype="Int64"),
                           loss_end=pd.array([m[2] if s else None for m, s in zip(made, spoken)], dtype="Int64"))

    # ids travel as strings: pandas would turn NULL integers into floats
    text = rows.withColumns({"conv": F.col("conv").cast("string"), "turn": F.col("turn").cast("string")})
    out = text.mapInPandas(run, "conv string, turn string, role string, text string, formatted string, loss_start long, loss_end long")
    return out.withColumns({"conv": F.col("conv").cast(conv), "turn": F.col("turn").cast(turn)})


def read_back(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Parse each conversation's formatted text and digest what comes out: a row
    per conversation with ``n_turns``, ``turns_sha256`` (role, newline, text,
    newline per turn), ``loss_chars`` and ``loss_sha256`` (texts under the loss
    mask, unescaped), ``formatted_chars`` and ``round_trip`` (the recovered
    turns are the source's).  Turns are ordered by (turn, role, text), NULL first;
    rows with a NULL conversation id are one conversation."""
    ship_package(turns.sparkSession)
    conv = turns.schema["conv"].dataType.simpleString()
    schema = ("conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, round_trip boolean")

    def run(batches):
        state, key = None, None

        def row():
            n, turns_hash, chars, loss_hash, formatted, same, parser = state
            return [key, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted, same and not parser.left]

        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            done = []
            for conv_id, role, text, piece, lo, hi in zip(b["conv"], b["role"], b["text"], b["formatted"], b["loss_start"], b["loss_end"]):
                if state is None or conv_id != key:
                    if state is not None:
                        done.append(row())
                    state, key = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, Parser()], conv_id
                back = list(state[6].feed(piece))
                state[0] += len(back)
                state[4] += len(piece)
                state[5] = state[5] and [x[:2] for x in back] == [(role, text)]
                for r, t, _, _ in back:
                    state[1].update(f"{r}\n{t}\n".encode())
                if lo == lo and lo is not None:
                    masked = unescape(piece[int(lo):int(hi)])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
            if done:
                yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([row()], columns=names)

    order = turns.select("conv", "turn", "role", "text", "formatted", "loss_start", "loss_end")
    order = order.repartition(F.col("conv")).sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text")])
    out = order.withColumns({"conv": F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))}).mapInPandas(run, schema)
    return out.withColumn("conv", F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(conv)).withColumnRenamed("conv", conv_col)
