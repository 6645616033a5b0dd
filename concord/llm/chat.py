"""Chat formatting in budgeted windows.

Each conversation is cut into windows of whole turns. Prefix sums of the turns'
token counts choose the span of new turns that fits a budget beside the retained
system turn and a limited history, the last turns of the span before, which is
repeated for context. Assistant texts that are new in a window are targets under
its loss mask; repeated ones are masked, so each target counts once.

A turn is written as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

In texts and roles, every `<` that stands before `|`, with backslashes between
or none, gets one backslash more, which takes away all control strings and is
undone by taking one away. In roles, newline and backslash are escaped too.

One conversation may hold a third of all turns: tokens are counted before rows are
dealt by conversation and sorted; then they are streamed, so that memory holds one
window and not a conversation.

Defined cases: null text is empty, null role is the empty role; rows of equal
turn are ordered by role and text, null turns come first; a null conversation id
is one conversation; a turn above the budget gets a window of its own, whole;
extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id bigint, window bigint, first_turn bigint, n_history bigint, n_new bigint, n_tokens bigint, formatted string, loss array<struct<start:bigint,end:bigint>>, last boolean"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def read_window(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the place of the escaped text, of each turn in a formatted window."""
    turns, at = [], 0
    while at < len(formatted):
        begin = at + len(START)
        line = formatted.index("\n", begin)
        end = formatted.index(END, line)
        turns.append((unescape_role(formatted[begin:line]), unescape(formatted[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return turns


def _sorted_turns(conversations: DataFrame, tokenizer: str | None) -> DataFrame:
    """conv_id, turn, role, text and tokens, counted where the rows are and not where a long conversation ends up."""
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part.append_column("tokens", pa.array(count(part.column(3).to_pylist()), pa.int64()))

    turns = turns.mapInArrow(counted, "conv_id bigint, turn bigint, role string, text string, tokens bigint")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


class _Conversation:
    """Builds the windows of one conversation from its turns, in order.

    sums[k] are the tokens of all turns before turns[k], of which only the history and
    the new turns are held: spans and their history are differences of prefix sums.
    """

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]
        self.begin = 0  # place of the first new turn
        self.old: list[tuple[str, str]] = []  # what the window repeats: the system turn and history
        self.old_tokens = self.seen = self.windows = 0

    def tokens(self) -> int:
        """Tokens of the window as it stands."""
        return self.old_tokens + self.sums[-1] - self.sums[self.begin]

    def add(self, role: str, text: str, tokens: int):
        done = None
        if len(self.turns) > self.begin and self.tokens() + tokens > self.budget:
            done = self.window(False)
        if not self.seen and role == "system":
            self.system = (role, text, tokens)
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + tokens)
        self.seen += 1
        return done

    def window(self, last: bool) -> dict:
        new = self.turns[self.begin :]
        system = [self.system] if self.system else []
        if self.tokens() > self.budget and len(new) == 1:
            self.old = [t[:2] for t in system] if self.windows else []
            self.old_tokens = sum(t[2] for t in system) if self.windows else 0
        out, loss, at = [], [], 0
        for k, (role, text) in enumerate(self.old + new):
            safe = escape(text)
            lead = f"{START}{escape_role(role)}\n"
            if k >= len(self.old) and role == "assistant":
                loss.append({"start": at + len(lead), "end": at + len(lead) + len(safe)})
            out.append(f"{lead}{safe}{END}\n")
            at += len(out[-1])
        row = {"window": self.windows, "first_turn": self.seen - len(new), "n_history": len(self.old), "n_new": len(new), "n_tokens": self.tokens(), "formatted": "".join(out), "loss": loss, "last": last}
        self._turn_over(system)
        return row

    def _turn_over(self, system: list[tuple[str, str, int]]) -> None:
        """The next window repeats the system turn and as much history as leaves half of the budget."""
        oldest = max(len(self.turns) - self.history, 1 if system and self.seen == len(self.turns) else 0)
        del self.turns[:oldest], self.sums[:oldest]
        self.begin = len(self.turns)
        self.old_tokens = sum(t[2] for t in system)
        room = self.budget // 2 - self.old_tokens
        first = min(bisect_left(self.sums, self.sums[-1] - room), self.begin)
        self.old = [t[:2] for t in system] + self.turns[first:]
        self.old_tokens += self.sums[-1] - self.sums[first]
        self.windows += 1


_TOKENIZERS: dict = {}


def _counter(path: str | None):
    """Token counts of a list of texts: by a tokenizer file, or words if there is none."""
    if path is None:
        return lambda texts: [len(t.split()) for t in texts]
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return lambda texts: [len(e.ids) for e in _TOKENIZERS[path].encode_batch_fast(texts, add_special_tokens=False)]


def windows(conversations: DataFrame, budget: int = 2048, history: int = 4, overhead: int = 8, tokenizer: str | None = None) -> DataFrame:
    """Formatted windows, by conversation and window within partitions; overhead: tokens of the template in a turn."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split(" ")[0] for p in re.sub("<[^ ]*,[^ ]*>", "", WINDOWS).split(", ")]
        kinds = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in names[1:6]), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("last", pa.bool_())])
        current, state, rows, chars = object(), None, [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for conv, role, text, n in zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                    if conv != current or state is None:
                        if state is not None:
                            rows.append(state.window(True) | {"conv_id": current})
                        current, state = conv, _Conversation(budget, history)
                    if done := state.add(role, text, n + overhead):
                        rows.append(done | {"conv_id": conv})
                        chars += len(done["formatted"])
                if len(rows) >= 512 or chars > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, chars = [], 0
        if state is not None:
            rows.append(state.window(True) | {"conv_id": current})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return _sorted_turns(conversations, tokenizer).mapInArrow(build, WINDOWS)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows say of each conversation; formatted: as `windows` returns them, in the same partitions and order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
        rows, state = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["window"] == 0:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns = read_window(row["formatted"])
                for role, text, _, _ in turns[row["n_history"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    plain = unescape(row["formatted"][span["start"] : span["end"]])
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(row["formatted"])
                state[5] += 1
                if row["last"]:
                    rows.append({"conv_id": row["conv_id"], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4], "n_windows": state[5]})
            if len(rows) >= 1024:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return formatted.mapInArrow(read, DIGESTS)
