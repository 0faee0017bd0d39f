"""Chat formatting: records of any known layout to canonical turns, and turns to marked text.

A record's layout is the set of its nested field paths; the hash of the sorted paths is its
fingerprint. A fingerprint selects a declarative mapping once per worker: the registered layout
with the most required paths that the record has. Turns are formatted one by one, so a
conversation of any length is rows of pieces and never one value.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLES = ("assistant",)
END = "</turn>\n"
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Either a list of messages, or single fields that each become a turn.

    `fields`: (role, paths); the non-empty texts of the paths are joined by a blank line.
    `optional` fields take part where a record has them. `aliases` rename roles.
    """

    name: str
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    aliases: dict = field(default_factory=dict, hash=False)

    def required(self) -> set[str]:
        if self.messages is not None:
            at = f"{self.messages}[]." if self.messages else ""
            return {at + self.role, at + self.text}
        return {p for _, paths in self.fields for p in paths} - set(self.optional)


MAPPINGS = (
    Mapping("turn", messages="", text="text"),
    Mapping("messages", messages="messages", aliases=ALIASES),
    Mapping("conversations", messages="conversations", role="from", text="value", aliases=ALIASES),
    Mapping("dialog", messages="dialog", role="speaker", text="text", aliases=ALIASES),
    Mapping("nested_messages", messages="data.messages", aliases=ALIASES),
    Mapping("prompt_completion", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Mapping("prompt_response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Mapping("instruction_response", fields=(("user", ("instruction", "context")), ("assistant", ("response",))), optional=("context",)),
    Mapping("question_answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves and empty containers; list items share one path."""
    found, todo = set(), [(value, at)]
    while todo:
        value, at = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(x, f"{at}.{k}" if at else k) for k, x in value.items()]
        elif isinstance(value, list) and value:
            todo += [(x, f"{at}[]") for x in value]
        else:
            found.add(at)
    return found


def fingerprint(paths: set[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"))


def select_mapping(paths: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    fitting = [m for m in mappings if m.required() <= paths]
    return max(fitting, key=lambda m: len(m.required()), default=None)


def _at(record, path: str):
    for key in path.split(".") if path else []:
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def turns_of(record, mapping: Mapping) -> Iterator[tuple[str, str]]:
    if mapping.messages is None:
        for role, paths in mapping.fields:
            texts = [_text(_at(record, p)) for p in paths]
            if any(texts) or not all(p in mapping.optional for p in paths):
                yield role, "\n\n".join(t for t in texts if t)
        return
    items = _at(record, mapping.messages)
    for item in items if isinstance(items, list) else [items]:
        item = item if isinstance(item, dict) else {}
        role = _text(item.get(mapping.role))
        yield mapping.aliases.get(role, role), _text(item.get(mapping.text))


_LONE = re.compile("[\ud800-\udfff]")
# Mappings of layouts a worker remembers; beyond that it starts anew, which only costs time.
KNOWN = 10_000


def well_formed(text: str | None) -> str | None:
    """The text with U+FFFD for halves of cut characters, which no UTF-8 text can hold."""
    return _LONE.sub("\ufffd", text) if text and not text.isascii() else text


TURN_SCHEMA = "layout string, fingerprint string, pos bigint, role string, text string"


def canonical_turns(records: DataFrame, keys: list[str], record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The key columns and (layout, fingerprint, pos, role, text): one row per turn, in order of pos.

    Null roles and texts are empty. A record that is null, no JSON, nested deeper than Python's JSON
    reader goes (about a thousand levels), or fits no layout gives one row with a null layout, role
    and text, so that it can be counted and kept aside. Halves of cut characters (lone surrogates)
    become U+FFFD. Repeated records give repeated turns. Columns other than the keys and the record
    are not passed on.
    """
    known: dict[str, Mapping | None] = {}

    def run(batches):
        for batch in batches:
            rows = {name: [] for name in ("at", "layout", "fingerprint", "pos", "role", "text")}
            for i, raw in enumerate(batch.column("__record").to_pylist()):
                try:
                    value = json.loads(raw) if raw is not None else None
                except (ValueError, RecursionError):
                    value = None
                paths = field_paths(value)
                print_ = fingerprint(paths)
                if print_ not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[print_] = select_mapping(paths, mappings) if isinstance(value, dict) else None
                mapping = known[print_]
                try:
                    turns = list(turns_of(value, mapping)) if mapping else [(None, None)]
                except RecursionError:  # writing nested values back as text goes less deep than reading
                    mapping, turns = None, [(None, None)]
                for pos, (role, text) in enumerate(turns):
                    made = (i, mapping.name if mapping else None, print_, pos, well_formed(role), well_formed(text))
                    for name, x in zip(rows, made):
                        rows[name].append(x)
            at = pa.array(rows["at"], pa.int64())
            kept = [batch.column(k).take(at) for k in range(len(keys))]
            made = [pa.array(rows["pos"], pa.int64()) if n == "pos" else pa.array(rows[n], pa.string()) for n in list(rows)[1:]]
            yield pa.RecordBatch.from_arrays(kept + made, [f"__k{k}" for k in range(len(keys))] + list(rows)[1:])

    types = dict(records.dtypes)
    picked = records.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col(f"`{record}`").cast("string").alias("__record"))
    schema = ", ".join([f"__k{i} {types[k]}" for i, k in enumerate(keys)] + [TURN_SCHEMA])
    made = picked.mapInArrow(run, schema)
    return made.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *[c.split()[0] for c in TURN_SCHEMA.split(", ")])


def escaped(text: Column) -> Column:
    """Reversible: backslashes doubled, and a backslash inside every control string.

    Three number signs or the end mark never occur in the result.
    """
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    hashes = F.regexp_replace(doubled, "#(?=##)", "#\\\\")
    return F.replace(hashes, F.lit("</turn>"), F.lit("<\\/turn>"))


def formatted_turns(turns: DataFrame) -> DataFrame:
    """Adds `piece`, the marked turn, and loss_start, loss_end: code points under the loss mask.

    The formatted conversation is its pieces in order. Only texts of trained roles are under the
    mask; the span is null for others. Null roles and texts are empty.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit("### "), F.replace(escaped(role), F.lit(":"), F.lit("\\:")), F.lit(": "))
    trained = role.isin(*TRAINED_ROLES)
    return turns.withColumns({"__head": head, "__body": escaped(text)}).withColumns({
        "piece": F.concat("__head", "__body", F.lit(END)),
        "loss_start": F.when(trained, F.length("__head")),
        "loss_end": F.when(trained, F.length("__head") + F.length("__body")),
    }).drop("__head", "__body")


_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a marked turn."""
    head = _HEAD.match(piece)
    if head is None or not piece.endswith(END) or END in piece[:-1]:
        raise ValueError(f"not a marked turn: {piece[:80]!r}")
    return unescaped(head.group(1)), unescaped(piece[head.end():-len(END)])


DIGEST_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(formatted: DataFrame, id: str, order: list[str]) -> DataFrame:
    """What a formatted data set says when it is read back: one row per conversation.

    Rows are dealt out by conversation and sorted; a task streams over them with one running
    digest, so a conversation needs no memory however long it is.
    """
    def run(batches):
        state, now = None, object()

        def result():
            n, turns, chars, loss, length = state
            return [now, n, turns.hexdigest(), chars, loss.hexdigest(), length]

        for batch in batches:
            done = []
            for conv, piece, start, end in zip(*[batch.column(n).to_pylist() for n in ("conv", "piece", "loss_start", "loss_end")]):
                if state is None or conv != now:
                    if state is not None:
                        done.append(result())
                    state, now = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv
                role, text = parse_piece(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    masked = unescaped(piece[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if done:
                yield _rows(done)
        if state is not None:
            yield _rows([result()])

    rows = formatted.select(F.col(f"`{id}`").cast("bigint").alias("conv"), "piece", "loss_start", "loss_end", *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    dealt = rows.repartition("conv").sortWithinPartitions("conv", *[f"__o{i}" for i in range(len(order))])
    return dealt.select("conv", "piece", "loss_start", "loss_end").mapInArrow(run, DIGEST_SCHEMA)


def _rows(rows: list) -> pa.RecordBatch:
    names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
    kinds = [pa.string() if "string" in c else pa.int64() for c in DIGEST_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
