"""Chat formatting in budgeted windows (operator 6)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import FLUSH_BYTES, blocks, default_tokenizer, named, tokenizer

#: Tokens of a window, and the most turns of earlier context that it repeats.
BUDGET, HISTORY = 512, 2
OPEN, CLOSE = "<s>", "</s>"
#: Strings that mean something to a chat model; none of them occurs in an escaped text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_SPECIAL = re.compile("|".join([re.escape("\\"), *(re.escape(c) for c in CONTROL)]))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL)

WINDOWS = "conv_id long, window int, first_turn long, repeated int, text string, loss array<struct<start: long, end: long>>, tokens long"


def escape(text: str) -> str:
    r"""Control strings broken by a backslash after their first character, and every backslash doubled.

    Nothing else is changed, and ``unescape`` gives the text back exactly: each backslash of the result stands
    before the character that it protects.
    """
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn by the template ``<s>role, line break, text</s>, line break``, and where its text begins."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    return head + escape(text) + CLOSE + "\n", len(head)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of a window: role, text, and the span of the escaped text."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(text)]


@dataclass
class Turn:
    text: str
    start: int
    tokens: int
    target: bool


@dataclass
class Conversation:
    """What is still needed of the conversation being read: its system turn, some context, and the open span."""

    conv_id: int | None
    budget: int
    history: int
    system: Turn | None = None
    context: list[Turn] = field(default_factory=list)
    span: list[Turn] = field(default_factory=list)
    prefix: list[int] = field(default_factory=lambda: [0])
    first: int = 0
    windows: int = 0

    def room(self) -> int:
        return self.budget - (self.system.tokens if self.system and self.first else 0)

    def add(self, turn: Turn, system: bool) -> tuple | None:
        """Take the next turn; the window that ends before it, if one does."""
        full = bool(self.span) and self.prefix[-1] + turn.tokens > self.room()
        done = self.close() if full else None
        if system and not self.first and not self.span:
            self.system = turn
        self.span.append(turn)
        self.prefix.append(self.prefix[-1] + turn.tokens)
        return done

    def close(self) -> tuple:
        """The open span as a window: the system turn again, what fits of the context, then the span."""
        room, repeated = self.room() - self.prefix[-1], []
        for turn in reversed(self.context):
            if turn.tokens > room:
                break
            room -= turn.tokens
            repeated.insert(0, turn)
        if self.system and self.first:
            repeated.insert(0, self.system)
        text, loss, tokens = "", [], 0
        for i, turn in enumerate([*repeated, *self.span]):
            if turn.target and i >= len(repeated):
                loss.append({"start": len(text) + turn.start, "end": len(text) + len(turn.text) - len(CLOSE) - 1})
            text += turn.text
            tokens += turn.tokens
        out = (self.conv_id, self.windows, self.first, len(repeated), text, loss, tokens)
        recent = [t for t in [*self.context, *self.span] if t is not self.system]
        self.context = recent[-self.history :] if self.history else []
        self.first += len(self.span)
        self.windows += 1
        self.span, self.prefix = [], [0]
        return out


def windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None,
    id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """Training windows of conversations given as rows by turn.

    Per window: conv_id, window (from 0), first_turn (its first new turn, from 0 in the conversation), repeated
    (how many turns at its start repeat earlier ones), text, loss (spans of characters in the text), tokens.

    A window takes whole turns while the prefix sum of their tokens stays within the budget, but one at least: a
    turn that is larger alone gives a window over budget, as turns are never cut. From the second window on, a
    conversation that begins with a system turn has it again at the start, and up to ``history`` turns before the
    span are repeated, newest first, if there is room. The loss covers the escaped text of assistant turns, each in
    the one window where it is new; repeated turns are masked.

    Rows are brought together and sorted by Spark; a task then reads them as a stream and holds one window, so a
    conversation may be of any length. Windows of a conversation come out in order, in one partition.

    Null text, role or turn: empty text, empty role, first turn. Rows without a conversation id are one
    conversation. Turns of equal number are ordered by role and text; repeated rows are turns of their own. Other
    columns are left out. An empty table gives an empty table.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).ids
        names = ["conv_id", "window", "first_turn", "repeated", "text", "loss", "tokens"]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), spans, pa.int64()]
        ready: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = [pa.array([r[i] for r in ready], k) for i, k in enumerate(kinds)]
            ready.clear()
            return pa.RecordBatch.from_arrays(out, names)

        open_: Conversation | None = None
        for batch in batches:
            held = 0
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                role, text = role.as_py(), text.as_py()
                if open_ is None or open_.conv_id != conv:
                    if open_ is not None:
                        ready.append(open_.close())
                    open_ = Conversation(conv, budget, history)
                formatted, start = render(role, text)
                turn = Turn(formatted, start, len(encode(formatted)), role == "assistant")
                if done := open_.add(turn, role == "system"):
                    ready.append(done)
                held += len(formatted)
                if held > FLUSH_BYTES and ready:
                    held = 0
                    yield flush()
            if ready:
                yield flush()
        if open_ is not None:
            ready.append(open_.close())
        yield flush()

    rows = turns.select(
        named(id_column).cast("long").alias("conv_id"), named(turn_column).cast("long").alias("turn"),
        *[F.coalesce(named(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_column, "role"), (text_column, "text"))],
    )
    dealt = rows.repartition(blocks(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from nothing but the windows as ``windows`` gives them: digests of its turns and of its loss.

    turns_sha256 covers role, line break, text, line break of each new turn; loss_sha256 and loss_chars the
    unescaped text under the loss; formatted_chars adds up the windows. Digests are fed window by window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ.split(", ")]
        ready: list[tuple] = []
        now: dict | None = None

        def flush() -> pa.RecordBatch:
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            out = [pa.array([r[i] for r in ready], k) for i, k in enumerate(kinds)]
            ready.clear()
            return pa.RecordBatch.from_arrays(out, names)

        def end() -> None:
            if now:
                ready.append((now["id"], now["turns"], now["said"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], now["windows"]))

        for batch in batches:
            for row in batch.to_pylist():
                if row["window"] == 0:
                    end()
                    now = {"id": row["conv_id"], "turns": 0, "said": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "windows": 0}
                fresh = parse(row["text"])[row["repeated"] :]
                for role, text, _, _ in fresh:
                    now["said"].update(f"{role}\n{text}\n".encode())
                now["turns"] += len(fresh)
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    now["loss"].update(text.encode())
                    now["loss_chars"] += len(text)
                now["chars"] += len(row["text"])
                now["windows"] += 1
            if ready:
                yield flush()
        end()
        yield flush()

    return formatted.mapInArrow(run, READ)
