"""Chat formatting: records of any known layout to canonical turns, and turns to one text.

The nested field paths of a record are hashed to its schema fingerprint, which selects a
declarative mapping; records without one are reported, not guessed at.
"""

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``turns`` are the fields that hold a message (``""``: the record is one) or a list of messages with
    ``role`` and ``text`` fields inside, one field after the other; otherwise each entry of ``fields`` is (role, paths):
    the non-empty values at the paths, joined by blank lines, make one turn. A text may be a list of parts.
    """

    turns: tuple[str, ...] = ()
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


# Names that public layouts give to the roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


def _step(key: str) -> str:
    """A key as a part of a path; one that could be taken for several parts is quoted."""
    return json.dumps(key) if any(c in '.[]{}"' for c in key) else key


def paths_of(value, prefix: str = "") -> set[str]:
    """Nested field paths; list items share the path ``[]``. Nulls count as present."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of(v, f"{prefix}.{_step(k)}" if prefix else _step(k))} or {prefix + "{}"}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, prefix + "[]")} or {prefix + "[]"}
    return {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8")).hexdigest()


class Layouts:
    """Mappings by the fingerprint of the paths that they need.

    Paths that no mapping needs (ids, names, scores, a rejected answer) are left out of a record's
    fingerprint. Those that some mapping needs count, so that a field that may bear a turn is never passed over.
    """

    def __init__(self) -> None:
        self.known: dict[str, Mapping] = {}
        self.needed: set[str] = set()

    def add(self, mapping: Mapping, *layouts: tuple[str, ...]) -> None:
        for paths in layouts:
            self.known[fingerprint(paths)] = mapping
            self.needed.update(paths)

    def mapping_of(self, record) -> Mapping | None:
        return self.known.get(fingerprint(paths_of(record) & self.needed))


def _layouts() -> Layouts:
    known = Layouts()
    add = known.add

    def contents(text: str) -> tuple[tuple[str, ...], ...]:
        """Texts as strings, as lists of parts, and both in one conversation."""
        return (text,), (f"{text}[].text",), (text, f"{text}[].text")

    for turns in ("messages", "conversations", "conversation", "turns"):
        for role, text in (("role", "content"), ("from", "value"), ("role", "text"), ("speaker", "text")):
            for paths in contents(f"{turns}[].{text}"):
                messages = (f"{turns}[].{role}", *paths)
                add(Mapping((turns,), role, text), messages)
                # A prompt beside the messages repeats the first of them.
                add(Mapping((turns,), role, text), ("prompt", *messages))
                add(Mapping((turns,), role, text, (("system", ("system",)),)), ("system", *messages))
        add(Mapping((turns,)), (f"{turns}[]",))
    for prompt in ("prompt", "question", "input", "instruction"):
        for answer in ("completion", "response", "answer", "output", "chosen"):
            pair = (("user", (prompt,)), ("assistant", (answer,)))
            add(Mapping(fields=pair), (prompt, answer))
            add(Mapping(fields=(("system", ("system",)), *pair)), ("system", prompt, answer))
    for answer in ("output", "response"):
        task = (("user", ("instruction", "input")), ("assistant", (answer,)))
        add(Mapping(fields=task), ("instruction", "input", answer))
        add(Mapping(fields=(("system", ("system",)), *task)), ("system", "instruction", "input", answer))
    # Prompt and answer as lists of messages; a chosen conversation may hold its prompt, or stand alone.
    for answer in ("completion", "chosen"):
        for said in contents(f"{answer}[].content"):
            reply = (f"{answer}[].role", *said)
            for asked in contents("prompt[].content"):
                add(Mapping(("prompt", answer), "role", "content"), ("prompt[].role", *asked, *reply))
            add(Mapping((answer,), "role", "content"), reply, ("prompt", *reply))
    # One turn as a record of its own.
    for text in ("text", "content"):
        add(Mapping(("",), "role", text), *(("role", *paths) for paths in contents(text)))
    return known


LAYOUTS = _layouts()


def _text(value) -> str | None:
    """A text, or the text parts of a list joined by blank lines; None if it is or has something else, such as a picture."""
    if isinstance(value, dict):
        return None
    if not isinstance(value, list):
        return "" if value is None else str(value)
    if any(not isinstance(part, dict) or part.get("type", "text") != "text" or isinstance(part.get("text"), (dict, list)) for part in value):
        return None
    return "\n\n".join(str(part["text"]) for part in value if part.get("text") not in (None, ""))


def turns_of(record, layouts: Layouts = LAYOUTS) -> list[tuple[str | None, str]] | None:
    """(role, text) of each turn of a record; None if no mapping has its fingerprint, or a part of a text is no text."""
    mapping = layouts.mapping_of(record)
    if mapping is None:
        return None
    raw = [(role, "\n\n".join(str(record[p]) for p in paths if record[p] not in (None, "")))
           for role, paths in mapping.fields]
    raw = [(r, t) for r, t in raw if r != "system" or t]
    messages = [m for f in mapping.turns for m in ([record] if f == "" else record[f])]
    if any(not isinstance(m, dict) or isinstance(m.get(mapping.role), (dict, list)) for m in messages):
        return None
    # A message may lack what others of its record have.
    raw += [(m.get(mapping.role), _text(m.get(mapping.text))) for m in messages]
    if len(mapping.turns) > 1 and record[mapping.turns[1]][:len(record[mapping.turns[0]])] == record[mapping.turns[0]]:
        del raw[:len(record[mapping.turns[0]])]
    if any(t is None for _, t in raw):
        return None
    return [(None if r is None else ROLES.get(str(r).lower(), str(r)), t) for r, t in raw]


# --- template -----------------------------------------------------------------------------

_CONTROL = re.compile(r"([\[<])(?=/?INST\]|/?s>|</?SYS>>|</?ROLE)")
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>"
    r"|<<ROLE(?P<role>.*?)>>(?P<other>.*?)<</ROLE>>|(?P<assistant>.*?)</s>", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and breaks each control string with one after its first character."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _name(role: str | None) -> str:
    """Other roles by name, percent-encoded; a null one has none, unlike an empty one."""
    return "" if role is None else "=" + quote(role, safe="")


def format_turn(role: str | None, text: str) -> tuple[str, tuple[int, int] | None]:
    """The turn's text, and the span of it that bears loss."""
    text = escape(text)
    if role == "assistant":
        return text + "</s>", (0, len(text))
    if role == "user":
        return f"[INST] {text} [/INST]", None
    if role == "system":
        return f"<<SYS>>{text}<</SYS>>", None
    return f"<<ROLE{_name(role)}>>{text}<</ROLE>>", None


def parse(formatted: str) -> Iterator[tuple[str | None, str]]:
    """The turns of a formatted text."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        if kind == "other":
            name = m.group("role")
            yield (None if name == "" else unquote(name[1:])), unescape(m.group("other"))
        else:
            yield kind, unescape(m.group(kind))
        at = m.end()


# --- Spark jobs ---------------------------------------------------------------------------

def _mapper(layouts: Layouts):
    def map_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, payload in enumerate(batch.column(0)):
                try:
                    record = json.loads(payload.as_py() or "null")
                    found = turns_of(record, layouts) if isinstance(record, dict) else None
                except (ValueError, RecursionError):  # no JSON, or nested beyond reading
                    found = None
                for n, (role, text) in enumerate(found if found is not None else [(None, "")]):
                    for column, value in zip(out, (i, n, role, text, found is not None)):
                        column.append(value)
            rest = [batch.column(c).take(pa.array(out[0], pa.int64())) for c in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()),
                 pa.array(out[4], pa.bool_())], names=[*batch.schema.names[1:], "_n", "_role", "_text", "_mapped"])
    return map_records


def canonical_turns(records: DataFrame, payload: Column, keep: list[str], layouts: Layouts = LAYOUTS) -> DataFrame:
    """Columns ``keep`` with role, text, n (place in the record) and mapped, a row for each turn.

    ``payload`` is the record as JSON. One that is null, no object, or of an unknown
    fingerprint gives a single row with mapped false, null role and empty text, so that nothing is lost unseen;
    so does one that holds parts other than texts. Empty lists of messages give no row, null texts are empty. A record
    is read whole in memory, however long. Repeated rows are mapped each; there are no ties to break. An empty table gives no rows. ``keep``
    may hold columns named role, text, n or mapped only if the caller renames them; other columns are not read.
    """
    source = records.select(payload.alias("_payload"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    schema = (source.drop("_payload").schema.add("_n", "integer").add("_role", "string").add("_text", "string").add("_mapped", "boolean"))
    out = source.mapInArrow(_mapper(layouts), schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)],
                      F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_n").alias("n"), F.col("_mapped").alias("mapped"))


class _Digest:
    """What is read back from one conversation's formatted text, piece by piece."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.formatted = 0

    def add(self, piece: str, loss: tuple[int, int] | None) -> None:
        self.formatted += len(piece)
        for role, text in parse(piece):
            self.n += 1
            self.turns.update(f"{'' if role is None else role}\n{text}\n".encode("utf-8"))
        if loss is not None:
            text = unescape(piece[loss[0]:loss[1]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8"))


def _stream(start: Callable, row: Callable, end: Callable):
    """Fold rows that come sorted by conversation, over the edges of batches."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = None, None
        for batch in batches:
            done = []
            for key, role, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                if state is None or key.as_py() != known:
                    if state is not None:
                        done.append(end(known, state))
                    known, state = key.as_py(), start()
                row(state, role.as_py(), text.as_py() or "")
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)
        if state is not None:
            yield pa.RecordBatch.from_pylist([end(known, state)], schema=_DIGESTS)
    return fold


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                      ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _take(state: _Digest, role: str | None, text: str) -> None:
    state.add(*format_turn(role, text))


def _close(key: int | None, s: _Digest) -> dict:
    return {"conv_id": key, "n_turns": s.n, "turns_sha256": s.turns.hexdigest(), "loss_chars": s.loss_chars,
            "loss_sha256": s.loss.hexdigest(), "formatted_chars": s.formatted}


def _sorted_turns(turns: DataFrame) -> DataFrame:
    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "n", "role", "text")
            .select(F.col("conv_id").cast("bigint"), "role", "text"))


def formatted_pieces(turns: DataFrame) -> DataFrame:
    """conv_id, turn, n, piece, loss_start, loss_end: each turn as its part of the formatted text.

    A conversation's text is its pieces in order of turn and n; the loss span is in characters of
    the piece, null if the turn bears none. No conversation has to fit in memory.
    """
    def pieces(batches):
        for batch in batches:
            made = [format_turn(r.as_py(), t.as_py() or "") for r, t in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([p for p, _ in made], pa.string()),
                 pa.array([l and l[0] for _, l in made], pa.int32()), pa.array([l and l[1] for _, l in made], pa.int32())],
                names=["conv_id", "turn", "n", "piece", "loss_start", "loss_end"])
    return turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "n", "role", "text").mapInArrow(
        pieces, "conv_id bigint, turn bigint, n int, piece string, loss_start int, loss_end int")


def read_back(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation.

    ``turns`` has conv_id, turn, n, role, text. Turns are formatted in order of turn (null
    first), n, role and text, and everything returned is parsed out of the formatted text. Null texts
    are empty, a null role is kept apart from an empty one in the text and hashes as empty,
    rows without conv_id are one conversation, repeated rows are repeated turns. An empty table gives no rows.
    A conversation is folded row by row: its length is bounded by disk, not by memory.
    """
    return _sorted_turns(turns).mapInArrow(
        _stream(_Digest, _take, _close), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint")
