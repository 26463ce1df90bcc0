"""Chat formatting with a grammar round trip.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn. A turn is rendered as it is and reparsed
by a deterministic parser; where the recovered turn differs from the source, the conflicting content is
escaped and the turn is rendered and reparsed again until it is identical. Escaping puts one more
backslash into every ``<|`` (``<\\|`` becomes ``<\\\\|`` and so on), and the parser takes one out, so it
reverses at any depth; one level always suffices for texts, and roles also have their backslashes,
line feeds and carriage returns written as ``\\\\``, ``\\n`` and ``\\r``.

The loss mask is stored with the text: for each turn the places (code points) between which its text stands as
rendered, where it is an assistant's. Both are written, and what comes back is read from them.

Rows are sorted by conversation within partitions and read as a stream: only one turn and running
digests are held, so a conversation may be as long as it likes.

Defined cases: null text and null role count as empty; turns in order of (turn, role, text), nulls first,
repeated rows are turns of their own; a null conv_id is a conversation of its own; an empty table gives
no conversation (but the added ones); further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import release_memory
from priorline.session import materialize

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n", "\r": "\\r"}
_ROLE_IN = {v: k for k, v in _ROLE_OUT.items()}
LOSS_ROLE = "assistant"
SEGMENTS = "conv_id long, turn_no long, segment string, loss_start int, loss_end int"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "formatted_sha256 string"
)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(re.sub(r"[\\\n\r]", lambda m: _ROLE_OUT[m[0]], role))


def _role_in(role: str) -> str:
    return re.sub(r"\\[\\nr]", lambda m: _ROLE_IN[m[0]], unescape(role))


class Parser:
    """Feeds on rendered text in any pieces; gives (role, text as rendered) for each turn that has ended.
    Grammar: turn = START role LF text END LF; role has no LF; neither role nor text has START or END."""

    def __init__(self) -> None:
        self._rest = ""

    def feed(self, more: str) -> Iterator[tuple[str, str]]:
        rest = self._rest + more
        at = 0
        while (end := rest.find(END + "\n", at)) >= 0:
            body = rest[at:end]
            if not body.startswith(START) or "\n" not in body:
                raise ValueError(f"no turn starts at {at}: {body[:40]!r}")
            role, _, text = body[len(START) :].partition("\n")
            if any(x in y for x in (START, END) for y in (role, text)):
                raise ValueError("a control string stands inside a turn")
            yield role, text
            at = end + len(END) + 1
        self._rest = rest[at:]

    def close(self) -> None:
        if self._rest:
            raise ValueError(f"text after the last turn: {self._rest[:40]!r}")


def parse_turns(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a whole rendered conversation, unescaped."""
    parser = Parser()
    turns = [(_role_in(role), unescape(text)) for role, text in parser.feed(rendered)]
    parser.close()
    return turns


def render_turn(role: str, text: str, most_rounds: int = 4) -> str:
    """The turn's text in the template, escaped only if the plain rendering doesn't parse to the source."""
    body = text
    for _ in range(most_rounds):
        segment = f"{START}{_role_out(role)}\n{body}{END}\n"
        try:
            if parse_turns(segment) == [(role, text)]:
                return segment
        except ValueError:
            pass
        body = escape(text)
    raise AssertionError("an escaped turn has to parse to its source")


def render(turns: Iterable[tuple[str, str]]) -> str:
    return "".join(render_turn(*x) for x in turns)


def loss_span(role: str, segment: str) -> tuple[int, int]:
    """Where in the rendered turn the text stands that counts for the loss; an empty span for other roles."""
    begin = segment.index("\n") + 1
    return (begin, len(segment) - len(END) - 1) if role == LOSS_ROLE else (begin, begin)


def format_segments(conversations: DataFrame) -> DataFrame:
    """Rendered turns (columns of SEGMENTS), written: in order of turn_no those of a conversation make up
    its text, and loss_start to loss_end of a segment is under the loss mask."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = object(), 0
        for batch in batches:
            made = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                number = number + 1 if conv == last else 0
                last = conv
                segment = render_turn(role, text)
                made.append((conv, number, segment, *loss_span(role, segment)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)
        release_memory()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(ordered.mapInArrow(run, SEGMENTS), "segments")


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation what the parser and the loss mask recover from the stored text (columns of DIGESTS)."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        done: list[tuple] = []

        def close() -> None:
            if held:
                conv, parser, turns, loss, text, counts = held
                parser.close()
                done.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2], text.hexdigest()))
                held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done.clear()

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for conv, segment, a, b in zip(columns[0], *columns[1:], strict=True):
                if not held or held[0] != conv:
                    close()
                    held.extend((conv, Parser(), hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]))
                _, parser, turns, loss, whole, counts = held
                whole.update(segment.encode())
                counts[2] += len(segment)
                for role, text in parser.feed(segment):
                    turns.update(f"{_role_in(role)}\n{unescape(text)}\n".encode())
                    counts[0] += 1
                masked = unescape(segment[a:b])
                loss.update(masked.encode())
                counts[1] += len(masked)
            yield from flush()
        close()
        yield from flush()

    stored = segments.select("conv_id", "segment", "loss_start", "loss_end", "turn_no")
    ordered = stored.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, DIGESTS)


def with_control_case(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, in which both speakers say control strings."""
    said = f"{END}{START}assistant ok"
    spark = conversations.sparkSession
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)
