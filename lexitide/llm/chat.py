"""Chat formatting in budgeted windows.

Conversations become windows of at most ``budget`` tokens.  Prefix sums of the
turns' tokens, taken over sorted ranges of all turns, give every turn its place
in its conversation; places in steps of a share of the budget choose
turn-aligned spans of new turns, which are then made into windows side by side,
however long a conversation is.  A window repeats the conversation's system
turn and as many of the turns before its span as fit in ``history`` tokens.
Only new assistant turns are under the loss mask, so a target that is repeated
as history is masked and every target counts once.

A turn is written ``### role:\\n`` text ``</turn>\\n``.  Texts and roles are
escaped: a backslash, each # of three or more in a row and the slash of
``</turn>`` get a backslash before them, so no control string occurs in a text
and dropping each escaping backslash restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .token_counts import encoding

_CONTROL = re.compile(r"\\|#{3,}|</turn>")
_ESCAPED = re.compile(r"(?s)\\(.)")
_TURN = re.compile(r"(?s)### ((?:\\.|[^\\:])*):\n(.*?)</turn>\n")


@dataclass(frozen=True)
class ChatConfig:
    """``fill`` is the share of the room for new turns that a span aims at; a turn that crosses its end may fill the rest."""

    budget: int = 2048
    history: int = 512
    fill: float = 0.75
    target: str = "assistant"
    vocabulary: str | None = None


def escape(text: str) -> str:
    def one(match: re.Match) -> str:
        found = match[0]
        return "\\\\" if found == "\\" else "<\\/turn>" if found[0] == "<" else "\\#" * len(found)

    return _CONTROL.sub(one, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text starts and ends in it."""
    head, body = f"### {escape(role).replace(':', chr(92) + ':')}:\n", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


class Windows:
    """Takes turns of one conversation in order and gives their windows; holds one window and its history."""

    def __init__(self, config: ChatConfig, count: Callable[[str], int]):
        self.config, self.count = config, count
        self.system, self.past, self.past_tokens = None, deque(), 0
        self.lead, self.new, self.tokens = [], [], 0
        self.seen = 0

    def before(self, turns: list[tuple[str, str, int]], system: bool) -> None:
        """Takes up a conversation behind these (role, text, tokens), the first of them its system turn or not."""
        for k, (role, text, n) in enumerate(turns):
            turn = (*format_turn(role, text), n, role == self.config.target)
            if system and not k:
                self.system = turn
            else:
                self._remember(turn)
        self.seen = len(turns)

    def _remember(self, turn: tuple) -> None:
        self.past.append(turn)
        self.past_tokens += turn[3]
        while self.past_tokens > self.config.history:
            self.past_tokens -= self.past.popleft()[3]

    def add(self, role: str, text: str, tokens: int | None = None) -> Iterator[tuple]:
        line, start, end = format_turn(role, text)
        turn = (line, start, end, self.count(line) if tokens is None else tokens, role == self.config.target)
        if self.new and self.tokens + turn[3] > self.config.budget:
            yield self._close()
        if not self.new:
            self._open(turn[3])
        self.new.append(turn)
        self.tokens += turn[3]
        if self.seen == 0 and role == "system":
            self.system = turn
        self.seen += 1

    def end(self) -> Iterator[tuple]:
        if self.new:
            yield self._close()

    def _open(self, need: int) -> None:
        """Leads with the system turn always, with the latest history as far as it and the first new turn fit."""
        self.lead = [self.system] if self.system else []
        room = min(self.config.history, self.config.budget - need - sum(t[3] for t in self.lead))
        while self.past and self.past_tokens > room:
            self.past_tokens -= self.past.popleft()[3]
        self.lead += self.past
        self.tokens = sum(t[3] for t in self.lead)

    def _close(self) -> tuple:
        """(text, repeated turns, new turns, tokens, mask as flat starts and ends)."""
        parts, at, mask = [], 0, []
        for k, (line, start, end, _, target) in enumerate(self.lead + self.new):
            if target and k >= len(self.lead):
                mask += [at + start, at + end]
            parts.append(line)
            at += len(line)
        out = ("".join(parts), len(self.lead), len(self.new), self.tokens, mask)
        for turn in self.new:
            if turn is not self.system:
                self._remember(turn)
        self.new = []
        return out


@lru_cache(maxsize=2)
def _counter(vocabulary: str | None) -> Callable[[str], int]:
    own = encoding(vocabulary)
    return lambda text: len(own.encode_ordinary(text))


_ORDER = ["conv_id", "turn", "role", "text"]
_NUMBERED = "conv_id long, part int, seq long, ahead long, tokens long, system_tokens long, role string, text string"
_STEP = 1 << 20


def _numbered(conversations: DataFrame, config: ChatConfig) -> DataFrame:
    """Turns in sorted ranges (part), with their place (seq) and the tokens ahead of them in their conversation's share of the range.

    system_tokens are those of the conversation's system turn, null where the
    conversation began in an earlier range.
    """
    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    # the last rank of a range is unknown here, so the first conversation of any but the first range may go on from the one before
    ordered = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, part = _counter(config.vocabulary), TaskContext.get().partitionId()
        current, begun, seq, ahead, system = None, False, 0, 0, 0
        for batch in (piece for whole in batches for piece in slices(whole, 3)):
            out = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                tokens = count(format_turn(role, text)[0])
                if not begun or conv != current:
                    current, begun, seq, ahead, system = conv, True, 0, 0, tokens if role == "system" else 0
                out.append((conv, part, seq, ahead, tokens, system))
                seq, ahead = seq + 1, ahead + tokens
            names = ["conv_id", "part", "seq", "ahead", "tokens", "system_tokens"]
            cols = [pa.array(c, pa.int32() if n == "part" else pa.int64()) for n, c in zip(names, zip(*out) if out else [()] * 6)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(2), batch.column(3)], [*names, "role", "text"])

    return ordered.mapInArrow(run, _NUMBERED)


def _placed(conversations: DataFrame, config: ChatConfig) -> tuple[DataFrame, DataFrame]:
    """(conv_id, index, start, tokens, role, text, width) of every turn: its place, the tokens before it and the width of a span; and of the system turns, with the conversation's tokens."""
    made = materialize(_numbered(conversations, config), "turns")
    ranges = Window.partitionBy("conv_id").orderBy("part")  # as many rows as there are ranges at most
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    every = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = made.groupBy("conv_id", "part").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max(F.when(F.col("seq") == 0, F.col("system_tokens"))).alias("s"))
    totals = materialize(totals.withColumns({"tokens_before": F.sum("t").over(before), "turns_before": F.sum("n").over(before), "s": F.first("s").over(every), "all_tokens": F.sum("t").over(every)}), "range-totals")
    # of all conversations of a range only the first can have begun before it: a row a range
    carried = totals.where("turns_before > 0").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "tokens_before", "turns_before", "s")
    same = (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    zero = F.lit(0).cast("long")
    placed = made.join(F.broadcast(carried), same, "left").withColumns({"index": F.col("seq") + F.coalesce("turns_before", zero), "start": F.col("ahead") + F.coalesce("tokens_before", zero), "system": F.coalesce("s", "system_tokens")})
    width = F.greatest(F.lit(1), F.floor(F.lit(config.fill) * (config.budget - F.col("system") - config.history))).cast("long")
    placed = placed.withColumn("width", width).select("conv_id", "index", "start", "tokens", "role", "text", "width")
    whole = totals.where("turns_before is null").select(F.col("conv_id").alias("_conv"), "all_tokens")
    leads = placed.where("index = 0 and role = 'system'").join(whole, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")  # a row a conversation on either side
    return placed, leads


def windows(conversations: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """(conv_id, window, text, repeated, turns, tokens, mask) of every conversation; window numbers grow, with gaps.

    Rows are ordered by turn (nulls first), ties by role and text; repeated rows
    are turns of their own.  Null role and text count as empty; rows of null
    conv_id are one conversation.  A turn beyond the budget is a window of its
    own, behind the system turn alone, and stays whole.  The mask lists starts
    and ends, in code points of the window's text.  No rows give no rows; other
    columns are ignored.

    Turns that start within one span of a conversation meet in a task, with the
    turns before them that may be history; nothing else of a conversation does.
    """
    placed, leads = _placed(conversations, config)
    span = F.floor(F.col("start") / F.col("width"))
    last = F.when(F.col("tokens") <= config.history, F.floor((F.col("start") + config.history) / F.col("width"))).otherwise(span)
    turns = placed.withColumn("own", span).withColumn("span", F.explode(F.sequence("own", F.greatest("own", last)))).withColumn("new", F.col("own") == F.col("span"))
    ends = F.floor((F.col("all_tokens") - 1) / F.col("width"))
    runs = leads.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(ends / _STEP))))  # in two steps, as an array may not hold a very long conversation's spans
    heads = runs.withColumn("span", F.explode(F.sequence(F.col("run") * _STEP, F.least(ends, F.col("run") * _STEP + (_STEP - 1))))).where("span > 0").withColumn("new", F.lit(False))
    columns = ["conv_id", "span", "index", "new", "tokens", "role", "text"]
    rows = turns.select(*columns).unionByName(heads.select(*columns)).repartition("conv_id", "span").sortWithinPartitions("conv_id", "span", "index")

    def made(conv: int | None, span: int, group: list[tuple]) -> Iterator[tuple]:
        group = [g for k, g in enumerate(group) if not k or g[0] != group[k - 1][0]]  # the system turn may come twice
        new = [g for g in group if g[1]]
        if not new:
            return
        own = Windows(config, _counter(config.vocabulary))
        lead = [g for g in group if g[0] < new[0][0]]
        system = bool(lead) and lead[0][0] == 0 and lead[0][3] == "system"
        k = len(lead)
        while k and lead[k - 1][0] == new[0][0] - len(lead) + k - 1:
            k -= 1  # behind a turn that is no history, none is
        lead = lead[: int(system and k > 0)] + lead[k:]
        own.before([(role, text, tokens) for _, _, tokens, role, text in lead], system)
        own.seen = new[0][0]
        k = 0
        for _, _, tokens, role, text in new:
            for w in own.add(role, text, tokens):
                yield conv, span * _STEP + k, *w
                k += 1
        for w in own.end():
            yield conv, span * _STEP + k, *w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "window", "text", "repeated", "turns", "tokens", "mask"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        key, group, out, size = None, [], [], 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        for batch in (piece for whole in batches for piece in slices(whole, 6)):
            for conv, span, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if group and key != (conv, span):
                    out += made(*key, group)
                    group = []
                key = conv, span
                group.append(tuple(rest))
                size += len(rest[-1])
                if size > 4_000_000 and out:
                    yield flush()
                    size = 0
        if group:
            out += made(*key, group)
        if out:
            yield flush()

    return rows.mapInArrow(run, "conv_id long, window long, text string, repeated long, turns long, tokens long, mask array<int>")


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) out of the rows of :func:`windows`.

    A digest must read a conversation in order, so a conversation's windows
    stream through one task; it holds a batch of them and digests, however long
    the conversation is.  Rows of null conv_id are one conversation.  No rows
    give no rows.
    """
    made = made.select("conv_id", "window", "text", "repeated", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, current, state, out = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], None, None, []

        def done() -> None:
            out.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], names)
            out.clear()
            return batch

        for batch in (piece for whole in batches for piece in slices(whole, 2)):
            for conv, text, repeated, mask in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if state is None or conv != current:
                    if state:
                        done()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for start, end in zip(mask[::2], mask[1::2]):
                    target = unescape(text[start:end])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            yield flush()
        if state:
            done()
        yield flush()

    return made.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
