"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of whole turns.  Prefix sums of turn
tokens choose each window's span; every later window starts with the system
turn and a limited history, neither of which is trained on again: each
assistant text is under the loss mask exactly once.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template. The two marks, and the control strings of other templates that texts must not carry raw.
TURN, END = "<|turn|>", "<|end|>\n"
CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>>|/?(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>)|\[(?=/?INST\]|/?(?:AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Break every control string by a backslash after its first character, and double the backslashes: no control string is left, and unescape() gives the text back."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "N" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and the code point span of each turn's text."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = TURN + escape(role).replace("\n", "\\N") + "\n"
        body = escape(text)
        spans.append((at + len(head), len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted window."""
    found = []
    for part in formatted.split(TURN)[1:]:
        role, _, body = part.partition("\n")
        found.append((unescape(role), unescape(body.removesuffix(END))))
    return found


class WindowBuilder:
    """Takes the turns of one conversation in order and gives back windows as they fill. Holds one window's turns, not the conversation."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []
        self.sums = [0]
        self.new = 0
        self.number = 0

    def add(self, role: str, text: str, tokens: int):
        """A window, if this turn doesn't fit into it any more."""
        if not self.turns and self.system is None and not self.number and role == "system":
            self.system = (role, text, tokens)
            return None
        out = None
        fixed = self.system[2] if self.system else 0
        if len(self.turns) > self.new and fixed + self.sums[-1] + tokens > self.budget:
            out = self.window()
            room = min(self.history, self.budget - fixed - tokens)
            cut = min(bisect_left(self.sums, self.sums[-1] - room), len(self.turns)) if room > 0 else len(self.turns)
            self.turns = self.turns[cut:]
            self.new = len(self.turns)
            self.sums = [x - self.sums[cut] for x in self.sums[cut:]]
        self.turns.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)
        return out

    def window(self) -> dict:
        turns = ([self.system] if self.system else []) + self.turns
        again = (len(turns) - len(self.turns) if self.number else 0) + self.new
        text, spans = render([t[:2] for t in turns])
        loss = [{"start": a, "length": n} for (role, _, _), (a, n) in list(zip(turns, spans, strict=True))[again:] if role == "assistant"]
        self.number += 1
        return {"window": self.number - 1, "text": text, "loss": loss, "n_repeated": again, "n_tokens": sum(t[2] for t in turns)}


SCHEMA = "conv_id long, window long, text string, loss array<struct<start:long,length:long>>, n_repeated long, n_tokens long"
ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("n_repeated", pa.int64()), ("n_tokens", pa.int64())])


def format_conversations(conversations: DataFrame, tokenizer_path: str, budget: int = 1024, history: int = 256, overhead: int = 6) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> windows (conv_id, window, text, loss spans, n_repeated leading turns, n_tokens).

    A turn costs the tokens of its text by the SentencePiece model at tokenizer_path and `overhead` for its marks. A
    turn is never cut: one that exceeds the budget has a window of its own beside the system turn. The system turn is
    a first turn of that role. Null roles and texts are empty; null turns come first; equal turns are ordered by role
    and text; repeated rows are turns of their own; a null conv_id is a conversation. Other columns are ignored.

    Conversations are sorted, not collected: a task holds one window of one conversation at a time."""

    def run(batches):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
        now, build, rows, held = object(), None, [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                roles = [x or "" for x in part.column(1).to_pylist()]
                texts = [x or "" for x in part.column(2).to_pylist()]
                counts = [len(x) for x in pieces.encode(texts, num_threads=1)]
                for conv, role, text, n in zip(part.column(0).to_pylist(), roles, texts, counts, strict=True):
                    if build is None or conv != now:
                        if build is not None:
                            rows.append({"conv_id": now} | build.window())
                        now, build = conv, WindowBuilder(budget, history)
                    if (w := build.add(role, text, n + overhead)) is not None:
                        rows.append({"conv_id": conv} | w)
                    held += len(text)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if build is not None:
            rows.append({"conv_id": now} | build.window())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, from its windows alone; windows in the order in which format_conversations gives them."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(batches):
        from hashlib import sha256

        now, state = None, None

        def closed():
            return {"conv_id": now, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["loss_n"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["chars"], "n_windows": state["w"]}

        def table(rows):
            return pa.RecordBatch.from_pylist(rows, pa.schema([(k, pa.string() if "sha" in k else pa.int64()) for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")]))

        for batch in batches:
            rows = []
            for conv, text, loss, again in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(closed())
                    now, state = conv, {"n": 0, "turns": sha256(), "loss_n": 0, "loss": sha256(), "chars": 0, "w": 0}
                for role, body in parse(text)[again:]:
                    state["turns"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    state["n"] += 1
                for span in loss:
                    plain = unescape(text[span["start"] : span["start"] + span["length"]])
                    state["loss"].update(plain.encode("utf-8", "surrogatepass"))
                    state["loss_n"] += len(plain)
                state["chars"] += len(text)
                state["w"] += 1
            if rows:
                yield table(rows)
        if state is not None:
            yield table([closed()])

    return windows.select("conv_id", "text", "loss", "n_repeated").mapInArrow(run, schema)
