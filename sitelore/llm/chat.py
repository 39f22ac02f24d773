r"""Chat formatting with schema fingerprints.

Records come as JSON in whatever layout their source used. The fingerprint of a record is a hash of its
nested field paths; it selects a declarative mapping (which paths hold the turns, their roles and texts, or
which field is which turn), once for each fingerprint. The mapping gives canonical turns (role, text), and the template
writes each turn as

    <|turn|>role \n text <|end|> \n

Control strings inside texts (``CONTROL``: the template's own and those of common chat templates) get a backslash behind their first character,
``[INST]`` becomes ``[\INST]``; one that has backslashes there already gets one more. All other text, code and markup included, stays as it is, no text
can hold a control string, and the text comes back exactly. In roles backslashes and line breaks are escaped as well, because a line break ends a role. The
loss mask is the spans of assistant texts, in code points of the formatted string.

Tables with a row for each turn are read by ``conversations``: rows are sorted by conversation and turn on the way, and a conversation streams through
its task in records of at most ``BLOCK_TURNS`` turns or ``BLOCK_CHARS`` characters, each formatted by itself; what follows one another in a conversation is
concatenated. So memory doesn't grow with a conversation. ``digests`` reads the turns and spans back, still in order, and keeps sums and running hashes only.

Cases: null or missing texts are empty, a null role too. A record that is no JSON object, or whose paths no mapping knows, gives no turns
and ``mapping`` null. An empty list gives no turns. Repeated records are formatted one by one; repeated rows of a turn are turns each, by role and text. Rows with a null conversation are one conversation. Other columns
are carried along by ``format_records`` and ignored by ``conversations``; own columns with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

TURN, END = "<|turn|>", "<|end|>\n"
# Control strings of the template and of common ones, as first character and what follows it.
AFTER_ANGLE = r"\|[^|<>\[\] \t\n\r\f]{1,64}\|>|/?s>|<SYS>>|</SYS>>|(?:start|end)_of_turn>|(?:bos|eos|pad|unk)>"
AFTER_BRACKET = r"/?INST\]"
CONTROL = rf"<(?=\\*(?:{AFTER_ANGLE}))|\[(?=\\*{AFTER_BRACKET})"
_TO = re.compile(CONTROL)
_FROM = re.compile(rf"<\\(?=\\*(?:{AFTER_ANGLE}))|\[\\(?=\\*{AFTER_BRACKET})")


def escape(text: str) -> str:
    return _TO.sub(lambda m: m[0] + "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _FROM.sub(lambda m: m[0][0], text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Mapping:
    """Where the turns are: a list field with role and text keys, or single fields in turn order."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    #: Fields joined by a blank line into the text of the field before them.
    joined: dict[str, str] = field(default_factory=dict, hash=False)
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    #: A field that is an earlier system turn if it is there.
    system: str = ""

    def needs(self) -> set[str]:
        return {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"} if self.turns else {f for f, _ in self.fields if f not in self.joined}

    def apply(self, record: dict) -> list[tuple[str, str]]:
        out = [("system", _text(record[self.system]))] if self.system and record.get(self.system) else []
        if self.turns:
            for t in record.get(self.turns) or []:
                if isinstance(t, dict):
                    role = _text(t.get(self.role))
                    out.append((self.roles.get(role, role), _text(t.get(self.text))))
            return out
        for name, role in self.fields:
            extra = [_text(record[k]) for k, to in self.joined.items() if to == name and record.get(k)]
            out.append((role, "\n\n".join([_text(record.get(name)), *extra])))
        return out


SHARED = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
#: Of mappings that fit, the one that needs most paths is taken, then the first.
MAPPINGS = (
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("messages text", turns="messages", role="role", text="text"),
    Mapping("shared turns", turns="conversations", role="from", text="value", roles=SHARED, system="system"),
    Mapping("conversation", turns="conversation", role="role", text="content", roles=SHARED),
    Mapping("dialogue", turns="dialog", role="speaker", text="text", roles=SHARED),
    Mapping("instruction", fields=(("instruction", "user"), ("output", "assistant")), joined={"input": "instruction"}, system="system"),
    Mapping("instruction response", fields=(("instruction", "user"), ("response", "assistant")), joined={"context": "instruction"}, system="system"),
    Mapping("prompt completion", fields=(("prompt", "user"), ("completion", "assistant")), system="system"),
    Mapping("prompt response", fields=(("prompt", "user"), ("response", "assistant")), system="system"),
    Mapping("question answer", fields=(("question", "user"), ("answer", "assistant")), joined={"context": "question"}, system="system"),
)


def _text(x) -> str:
    if x is None:
        return ""
    if isinstance(x, str):
        return x
    if isinstance(x, list):  # content in parts
        return "".join(_text(p.get("text") if isinstance(p, dict) else p) for p in x)
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


def paths(x, at: str = "") -> set[str]:
    """Nested field paths; the elements of a list share one path."""
    if isinstance(x, dict):
        return {p for k, v in x.items() for p in paths(v, f"{at}.{k}" if at else k)} or {at}
    if isinstance(x, list):
        return {p for v in x for p in paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(record) -> str:
    return hashlib.blake2b("\n".join(sorted(paths(record))).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Formatter:
    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.chosen: dict[str, Mapping | None] = {}

    def choose(self, record) -> tuple[str, Mapping | None]:
        mark = fingerprint(record)
        if mark not in self.chosen:
            have = paths(record)
            have |= {m.group(0) for p in have for m in [re.match(r"[^.\[]+\[\]\.[^.\[]+", p)] if m} | {re.split(r"[.\[]", p)[0] for p in have}
            fit = [m for m in self.mappings if m.needs() <= have or (m.turns and f"{m.turns}[]" in have)]
            if len(self.chosen) > 10_000:
                self.chosen.clear()
            self.chosen[mark] = max(fit, key=lambda m: (len(m.needs()), -self.mappings.index(m)), default=None)
        return mark, self.chosen[mark]

    def turns(self, source: str | None) -> tuple[str | None, str | None, list[tuple[str, str]]]:
        """(fingerprint, mapping name, canonical turns) of a record in JSON."""
        try:
            record = json.loads(source) if source else None
        except ValueError:
            record = None
        return self.record(record) if isinstance(record, dict) else (None, None, [])

    def record(self, record: dict) -> tuple[str | None, str | None, list[tuple[str, str]]]:
        mark, mapping = self.choose(record)
        return mark, mapping.name if mapping else None, mapping.apply(record) if mapping else []


def write(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns back out of a formatted conversation."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape_role(role), unescape(body[: -len(END)])))
    return out


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULTS = [T.StructField("fingerprint", T.StringType()), T.StructField("mapping", T.StringType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", SPANS), T.StructField("turns", TURNS), T.StructField("loss_text", T.StringType())]


def format_records(records: DataFrame, *, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The rows without the JSON column, with fingerprint, mapping, formatted and loss_spans; turns and loss_text are read back from these two."""
    kept = [f for f in records.schema.fields if f.name != record and f.name not in {r.name for r in RESULTS}]
    schema = T.StructType([*kept, *RESULTS])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in RESULTS]

    def run(batches):
        formatter = Formatter(mappings)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cols: list[list] = [[] for _ in RESULTS]
                for x in part.column(len(kept)):
                    mark, name, turns = formatter.turns(x.as_py())
                    formatted, spans = write(turns)
                    row = (mark, name, formatted, [{"start": a, "end": b} for a, b in spans], [{"role": r, "text": t} for r, t in read(formatted)], "".join(unescape(formatted[a:b]) for a, b in spans))
                    for c, v in zip(cols, row):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

    return records.select(*[f"`{f.name}`" for f in kept], f"`{record}`").mapInArrow(run, schema)


#: Most turns, and characters beyond which no turn is added, of one record of a conversation.
BLOCK_TURNS, BLOCK_CHARS = 256, 1_000_000
BLOCKS = [T.StructField("block", T.LongType()), *(f for f in RESULTS if f.name in ("fingerprint", "mapping", "formatted", "loss_spans"))]


def conversations(rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, block, fingerprint, mapping, formatted, loss_spans): the records of each conversation, in order within a partition; spans count from the start of the conversation.

    Turns follow one another by ``turn``, rows of one turn by role and text.
    """
    schema = T.StructType([rows.schema[id], *BLOCKS])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        formatter = Formatter()
        out: list[list] = [[] for _ in schema]
        said: list[dict] = []
        key, block, at, chars, size = None, 0, 0, 0, 0

        def put():
            nonlocal block, at, chars, size
            mark, name, turns = formatter.record({"messages": said})
            formatted, spans = write(turns)
            for c, v in zip(out, (key, block, mark, name, formatted, [{"start": at + a, "end": at + b} for a, b in spans])):
                c.append(v)
            block, at, chars, size = block + 1, at + len(formatted), 0, size + len(formatted)
            said.clear()

        def take():
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)
            for c in out:
                c.clear()
            size = 0
            return batch

        for batch in batches:
            for k, r, x in zip(*(c.to_pylist() for c in batch.columns)):
                if said and (k != key or len(said) >= BLOCK_TURNS or chars >= BLOCK_CHARS):
                    put()
                    if size > BLOCK_CHARS:
                        yield take()
                if k != key:
                    key, block, at = k, 0, 0
                said.append({"role": r, "content": x})
                chars += len(x)
        if said:
            put()
        yield take()

    plain = rows.select(F.col(id).alias("__id"), F.col(turn).alias("__turn"), F.coalesce(role, F.lit("")).alias("__role"), F.coalesce(text, F.lit("")).alias("__text"))
    dealt = small_batches(plain).repartition("__id").sortWithinPartitions("__id", "__turn", "__role", "__text")
    return dealt.select("__id", "__role", "__text").mapInArrow(run, schema)


def digests(blocks: DataFrame, *, id: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of conversations as ``conversations`` gives them, read back from formatted text and spans."""
    schema = T.StructType([blocks.schema[id], *(T.StructField(n, T.StringType() if n.endswith("sha256") else T.LongType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        out: list[list] = [[] for _ in schema]
        key = turns = loss = None
        n = learnt = length = 0

        def put():
            for c, v in zip(out, (key, n, turns.hexdigest(), learnt, loss.hexdigest(), length)):
                c.append(v)

        for batch in batches:
            for k, block, formatted, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if block == 0:
                    if turns is not None:
                        put()
                    key, turns, loss, n, learnt, length = k, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for r, x in read(formatted):
                    turns.update(f"{r}\n{x}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in spans:
                    x = unescape(formatted[span["start"] - length : span["end"] - length])
                    loss.update(x.encode("utf-8", "surrogatepass"))
                    learnt += len(x)
                length += len(formatted)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)
                out = [[] for _ in schema]
        if turns is not None:
            put()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return blocks.select(id, "block", "formatted", "loss_spans").mapInArrow(run, schema)
