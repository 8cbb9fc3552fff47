"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose windows of whole turns: a window holds the system turn (kept in every window), then
repeated history of at most ``history`` tokens, then as many new turns as the budget leaves, one at least. Only new
assistant turns count for the loss, so each target is trained once however often it is repeated as history.

A turn reads ``<|turn|>role\\ntext<|end|>\\n``; a repeated one starts with ``<|context|>``. Control strings inside
texts and roles get a backslash after their first character (strings that look escaped get one more), which reading
takes off again, so every text comes back as it was.

Rows of a conversation are sorted by turn (ties: role, text) and stream through one task, which holds no more than a
window and its history; a conversation of any length needs bounded memory. Null texts and roles count as empty. A turn
longer than the budget makes a window of its own. Null ids form one conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .prefix_counts import loaded

#: Control strings of common chat templates; the lookahead follows their first character and any backslashes.
_control = r"(?=\||/?s>|/?INST\]|/?SYS>>)"
_plain = re.compile(rf"([<\[])(\\*){_control}")
_escaped = re.compile(rf"([<\[])(\\*)\\{_control}")
_turn = re.compile(r"<\|(turn|context)\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """Text without control strings."""
    return _plain.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return _escaped.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    """Like ``escape``, on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Windows:
    """Windows of one conversation at a time, turn by turn."""

    def __init__(self, count, budget: int, history: int):
        self.count, self.budget, self.history = count, budget, history

    def begin(self) -> None:
        self.system: tuple[str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []  # (role, formatted rest, characters before the text)
        self.sums = [0]
        self.new = 0  # the first turn that no window has had
        self.first = True
        self.number = 0

    def add(self, role: str, text: str) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
        head, body = f"{escape_role(role)}\n", escape(text)
        n = self.count(f"<|turn|>{head}{body}<|end|>\n")
        if self.new < len(self.turns) and self._repeated(self.new) + self.sums[-1] - self.sums[self.new] + n > self._room():
            yield self.flush()
        self.turns.append((role, f"{head}{body}<|end|>\n", len(head)))
        self.sums.append(self.sums[-1] + n)

    def _room(self) -> int:
        return self.budget - (self.system[1] if self.system and not self.first else 0)

    def _from(self, new: int) -> int:
        """The first turn of the history before ``new``; none if it leaves no room for one new turn."""
        if self.first:
            return new
        h = bisect_left(self.sums, self.sums[new] - self.history, 0, new)
        if new < len(self.turns) and self.sums[new + 1] - self.sums[h] > self._room():
            return new
        return h

    def _repeated(self, new: int) -> int:
        return self.sums[new] - self.sums[self._from(new)]

    def flush(self) -> tuple[int, str, list[tuple[int, int]]]:
        """The window of all turns that are new; then only what may be repeated stays."""
        h, parts, loss, at = self._from(self.new), [], [], 0
        if self.system and not self.first:
            parts.append(f"<|context|>{self.system[0]}")
            at = len(parts[0])
        for i in range(h, len(self.turns)):
            role, rest, head = self.turns[i]
            mark = "<|context|>" if i < self.new else "<|turn|>"
            if i >= self.new and role == "assistant":
                loss.append((at + len(mark) + head, at + len(mark) + len(rest) - len("<|end|>\n")))
            parts.append(mark + rest)
            at += len(parts[-1])
        if self.first and self.turns and self.turns[0][0] == "system":
            self.system = self.turns[0][1], self.sums[1] - self.sums[0]
        keep = bisect_left(self.sums, self.sums[-1] - self.history)
        if self.first and self.system:
            keep = max(keep, 1)
        out = self.number, "".join(parts), loss
        self.turns, base = self.turns[keep:], self.sums[keep]
        self.sums = [s - base for s in self.sums[keep:]]
        self.new, self.first, self.number = len(self.turns), False, self.number + 1
        return out


def formatted(rows: DataFrame, vocabulary: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows (conv_id, window, text, loss: spans of characters) of rows (conv_id, turn, role, text), in order within
    each partition."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, now, started = Windows(loaded(vocabulary).count, budget, history), None, False
        out: list[tuple] = []
        size = 0
        for b in batches:
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not started or conv != now:
                    if started:
                        out.append((now, *windows.flush()))
                    windows.begin()
                    now, started = conv, True
                out += [(now, *w) for w in windows.add(role, text)]
                size += len(text)
                if size > 4 << 20:
                    yield _windows(out)
                    out, size = [], 0
        if started:
            out.append((now, *windows.flush()))
        if out:
            yield _windows(out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, window long, text string, loss array<struct<start: long, end: long>>")


def _windows(out: list[tuple]) -> pa.RecordBatch:
    conv, number, text, loss = zip(*out, strict=True) if out else ([], [], [], [])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, pa.int64()), pa.array(number, pa.int64()), pa.array(text, pa.string()), pa.array([[{"start": a, "end": z} for a, z in x] for x in loss], pa.list_(span))],
        ["conv_id", "window", "text", "loss"],
    )


def read(text: str) -> list[tuple[str, str, bool]]:
    """(role, text, whether it's repeated) of each turn of a window."""
    return [(unescape_role(r), unescape(t), mark == "context") for mark, r, t in _turn.findall(text)]


def digest(windows: DataFrame) -> DataFrame:
    """What the windows say, read back: one row for each conversation. Needs ``formatted``'s order of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        state: list | None = None

        def row() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6])

        for b in batches:
            out = []
            for conv, text, loss in zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist(), b.column("loss").to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said, repeated in read(text):
                    if not repeated:
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode())
                for x in loss:
                    target = unescape(text[x["start"] : x["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
                state[6] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(), kinds, strict=True)], names)

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, with conversation -7. Null roles and texts are empty; turns of one number
    are ordered by role and text, repeated rows are repeated turns; an empty table gives conversation -7 alone; other
    columns are ignored."""
    said = "</s>[INST] ok [/INST]"
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(formatted(rows.unionByName(extra), common.tokenizer_path("byte_bpe_50k.json")))
