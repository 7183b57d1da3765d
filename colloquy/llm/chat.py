"""Budgeted windows over chat turns, in a template that can be read back.

Turns of a conversation stream through one task in turn order; only the system
turn, the history to repeat and the window being filled are held, so a
conversation of any length needs bounded memory. It cannot be split further
when its digest is wanted, as that runs over all turns in order.

Rows: a NULL text or role is the empty string, a NULL turn sorts first, a NULL
conversation id is a conversation of its own, and repeated rows are turns like
any other. Ties of ``turn`` are ordered by role, then text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY = 512

# A control string is its first character, any number of backslashes, and its rest.
# Escaping adds one backslash there and unescaping takes one away, so no text of a
# turn holds a bare control string, and matches cannot overlap.
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>)")
_AFTER = {"[INST] ": " [/INST]", "<<SYS>>\n": "\n<</SYS>>\n", "<s>": " </s>", " ": " </s>"}
_BEFORE = {"user": "[INST] ", "system": "<<SYS>>\n", "assistant": " "}
_ROLES = {v: k for k, v in _BEFORE.items()}


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its escaped text starts and ends in it."""
    before = _BEFORE.get(role, "<s>")
    head = before
    if before == "<s>":  # any other role is written out, on one line
        head += escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + _AFTER[before], len(head), len(head) + len(body)


def _role_name(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of every turn of a window; the span is that of the escaped text."""
    out, at = [], 0
    while at < len(window):
        before = next(b for b in _AFTER if window.startswith(b, at))
        start = at + len(before)
        if before == "<s>":
            line = window.index("\n", start)
            role, start = _role_name(window[start:line]), line + 1
        else:
            role = _ROLES[before]
        end = window.index(_AFTER[before], start)
        out.append((role, unescape(window[start:end]), start, end))
        at = end + len(_AFTER[before])
    return out


def word_tokens(texts: list[str]) -> list[int]:
    """Stand-in count where no tokenizer is given: words and single marks."""
    return [len(re.findall(r"\w+|[^\w\s]", t)) for t in texts]


def tokenizer_counts(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts by a tokenizer file that ``tokenizers`` reads; loaded once per worker."""

    def count(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in _loaded(path).encode_batch(texts, add_special_tokens=False)]

    return count


_TOKENIZERS: dict = {}


def _loaded(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


class _Windows:
    """Cuts the turns of one conversation into windows."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.fresh, self.past, self.number, self.first = None, [], [], 0, True

    def used(self) -> int:
        """Prefix sum of the window: retained system turn, repeated turns, new turns."""
        system = self.system[3] if self.system and self.number else 0
        return system + sum(t[3] for t in self.past) + sum(t[3] for t in self.fresh)

    def add(self, turn):
        """``turn`` is (rendered, start or -1, end, tokens); yields a window when it is full."""
        role_is_system, turn = turn[0], turn[1:]
        if self.fresh and self.used() + turn[3] > self.budget:
            yield self.close()
        while self.past and self.used() + turn[3] > self.budget:
            self.past.pop(0)  # history gives way, oldest first
        if self.first and role_is_system:
            self.system = turn
        self.first = False
        self.fresh.append(turn)

    def close(self):
        repeated = ([self.system] if self.system and self.number else []) + self.past
        text, spans, at = [], [], 0
        for k, (rendered, start, end, _) in enumerate(repeated + self.fresh):
            if k >= len(repeated) and start >= 0:
                spans.append((at + start, at + end))
            text.append(rendered)
            at += len(rendered)
        row = (self.number, "".join(text), len(repeated), len(self.fresh), self.used(), spans)
        # The turns to repeat: the longest turn-aligned suffix within the history budget.
        tail, room = [], self.history
        for turn in reversed(self.past + self.fresh):
            if turn is self.system or turn[3] > room:
                break
            room -= turn[3]
            tail.insert(0, turn)
        self.past, self.fresh, self.number = tail, [], self.number + 1
        return row


def chat_windows(
    turns: DataFrame,
    count: Callable[[list[str]], list[int]] = word_tokens,
    budget: int = BUDGET,
    history: int = HISTORY,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Windows of whole turns within ``budget`` tokens.

    Returns ``(key, window, formatted, n_repeated, n_new, n_tokens, loss_spans)``,
    in order within each partition. Every window but the first starts with the
    conversation's system turn, if its first turn is one, and repeats up to
    ``history`` tokens of whole turns before its new ones. ``loss_spans`` covers
    the assistant texts among the new turns only, so every assistant text is a
    target once. A turn above the budget has a window to itself and is not cut.
    """
    kind = turns.schema[key].dataType.simpleString()
    rows = turns.select(
        F.col(key).alias("_key"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    ordered = rows.repartition("_key").sortWithinPartitions("_key", "_turn", "_role", "_text")
    spans_type = "array<struct<start:bigint,end:bigint>>"

    def run(batches):
        key_now, state, out, held = None, None, [], 0
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            roles, texts = batch.column("_role").to_pylist(), batch.column("_text").to_pylist()
            rendered = [render(r, t) for r, t in zip(roles, texts)]
            tokens = count([x[0] for x in rendered])
            for k, r, (shown, start, end), n in zip(keys, roles, rendered, tokens):
                if state is None or k != key_now:
                    if state is not None:
                        out.append((key_now, *state.close()))
                    key_now, state = k, _Windows(budget, history)
                at = start if r == "assistant" else -1
                for row in state.add((r == "system", shown, at, end, n)):
                    out.append((key_now, *row))
                    held += len(row[1])
            if held > 1 << 20 or len(out) > 1000:
                yield _table(out, batch.schema.field("_key").type)
                out, held = [], 0
        if state is not None:
            out.append((key_now, *state.close()))
        if out:
            yield _table(out, pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32())

    return ordered.mapInArrow(
        run,
        f"`{key}` {kind}, window bigint, formatted string, n_repeated bigint, n_new bigint, n_tokens bigint, "
        f"loss_spans {spans_type}",
    )


def _table(rows, key_type) -> pa.RecordBatch:
    keys, window, text, repeated, new, tokens, spans = zip(*rows)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    arrays = [pa.array(keys, key_type), pa.array(window, pa.int64()), pa.array(text, pa.string())]
    arrays += [pa.array(x, pa.int64()) for x in (repeated, new, tokens)]
    arrays.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(span)))
    names = ["_key", "window", "formatted", "n_repeated", "n_new", "n_tokens", "loss_spans"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def window_digests(windows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation what its windows say when parsed and unescaped.

    ``windows`` holds each conversation's windows in order within one partition,
    as ``chat_windows`` leaves them; a conversation is digested as it streams by.
    """
    kind = windows.schema[key].dataType.simpleString()
    narrow = windows.select(F.col(key).alias("_key"), "formatted", "n_repeated", "loss_spans")

    def run(batches):
        state, key_now, out = None, None, []

        def closed():
            turns, n, loss, loss_chars, chars = state
            return key_now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for row in batch.to_pylist():
                if state is None or row["_key"] != key_now:
                    if state is not None:
                        out.append(closed())
                    key_now, state = row["_key"], [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = row["formatted"]
                for role, said, _, _ in parse(text)[row["n_repeated"] :]:
                    state[0].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    state[1] += 1
                for span in row["loss_spans"]:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2].update(target.encode("utf-8", "surrogatepass"))
                    state[3] += len(target)
                state[4] += len(text)
            if len(out) > 1000:
                yield _digests(out, key_type)
                out = []
        if state is not None:
            out.append(closed())
            yield _digests(out, key_type)

    return narrow.mapInArrow(
        run,
        f"`{key}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint",
    )


def _digests(rows, key_type) -> pa.RecordBatch:
    types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["_key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
