"""Chat formatting: schema fingerprints select declarative mappings from record layouts to canonical turns.

Everything here is DataFrame and SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh, let, running_sums

TURN = "struct<role:string,text:string>"

# The marks of the template, and the control strings of common chat templates.
OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: A control string with any number of backslashes after its first character; escaping adds one, and
#: unescaping takes one away, so every text has one escaped form and comes back unchanged.
_REST = "|".join(sorted({"\\Q" + c[1:] + "\\E" for c in CONTROL}))
_PLAIN = rf"([<\[])(\\*)(?={_REST})"
_ESCAPED = rf"([<\[])\\(\\*)(?={_REST})"

#: Field names that mappings know. Scalars of other names do not change a record's fingerprint.
FIELDS = ("messages", "conversations", "conversation", "turns", "role", "from", "text", "content", "value", "prompt", "completion", "response", "chosen", "instruction", "input", "output", "system", "question", "answer")


@dataclass(frozen=True)
class Layout:
    """A record layout: its nested field paths, and where the turns are in it.

    ``turns`` names an array and the fields of role and text in its elements; else ``parts`` lists
    (role, fields whose non-empty texts are joined by a blank line), one turn each.
    """

    name: str
    paths: str
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()


def _of_array(array: str, role: str, text: str) -> Layout:
    a, b = sorted((role, text))
    return Layout(f"{array}.{role}.{text}", f"OBJECT<{array}: ARRAY<OBJECT<{a}, {b}>>>", turns=(array, role, text))


def _of_parts(*parts: tuple[str, tuple[str, ...]]) -> Layout:
    fields = sorted(f for _, fs in parts for f in fs)
    return Layout("+".join(fields), f"OBJECT<{', '.join(fields)}>", parts=parts)


_S = ("system", ("system",))
LAYOUTS: tuple[Layout, ...] = (
    *[_of_array(a, r, t) for a in ("messages", "conversations", "conversation", "turns") for r, t in (("role", "content"), ("role", "text"), ("from", "value"))],
    *[
        _of_parts(*s, ("user", u), ("assistant", a))
        for s in ((), (_S,))
        for u, a in (
            (("prompt",), ("completion",)),
            (("prompt",), ("response",)),
            (("prompt",), ("chosen",)),
            (("instruction",), ("output",)),
            (("instruction", "input"), ("output",)),
            (("instruction",), ("response",)),
            (("question",), ("answer",)),
        )
    ],
)

# Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


#: Every array's elements may hold these; a record is read into all known fields at once.
_ELEMENT = "struct<" + ",".join(f"`{f}`:string" for f in ("role", "from", "text", "content", "value")) + ">"
_ARRAYS = ("messages", "conversations", "conversation", "turns")
_RECORD = "struct<" + ",".join([f"`{a}`:array<{_ELEMENT}>" for a in _ARRAYS] + [f"`{f}`:string" for f in FIELDS if f not in _ARRAYS]) + ">"
#: The parser's own limit on one text is 20 million characters; a text here may be as long as a column can hold.
_JSON = {"maxStringLen": str(2**31 - 1)}


def skeleton(record: Column) -> Column:
    """A JSON text with its escapes and every string of 100 characters or more taken out: its fields, and little else.

    What is left parses in small memory however long the texts are. Names of known fields are short and
    have no escapes, so they stay.
    """
    return F.regexp_replace(F.regexp_replace(record, r"\\.", ""), r'"([^"]{0,99}+)"|"[^"]*+"', '"$1"')


def nested_paths(record: Column) -> Column:
    """Known nested field paths of a JSON text, names sorted at each level, without the types of scalars; null for no JSON."""
    scalar = r"(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\s*\d+\))"
    schema = F.schema_of_variant(F.try_parse_json(skeleton(record)))
    known = "|".join(FIELDS)
    schema = F.regexp_replace(schema, rf"(?<=[<\s])(?!(?:{known}): )(?:\w+|`[^`]*`): {scalar}(?:, |(?=>))", "")
    schema = F.regexp_replace(schema, rf": {scalar}", "")
    return F.regexp_replace(schema, r",\s*(?=>)", "")


def _path(name: str, kind: T.DataType) -> str | None:
    """A field with what is nested in it; None for a scalar that no mapping knows."""
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return f"{name}: {paths_of_type(kind)}"
    return name if name in FIELDS else None


def paths_of_row(record: Column, kind: T.StructType) -> Column:
    """The paths of the fields that hold something in a row of a column of structs, which may have the fields of many layouts."""
    shown = sorted((f.name, _path(f.name, f.dataType)) for f in kind.fields if _path(f.name, f.dataType))
    return F.concat(F.lit("OBJECT<"), F.concat_ws(", ", *[F.when(record[n].isNotNull(), F.lit(p)) for n, p in shown]), F.lit(">"))


def paths_of_type(kind: T.DataType) -> str:
    """The paths of all fields of a type."""
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{paths_of_type(kind.elementType)}>"
    if not isinstance(kind, T.StructType):
        return "SCALAR"
    return f"OBJECT<{', '.join(sorted(p for f in kind.fields if (p := _path(f.name, f.dataType))))}>"


def fingerprint(record: Column) -> Column:
    return F.xxhash64(nested_paths(record))


def _turns(layout: Layout, got: Column, alias: Column) -> Column:
    """Canonical turns that a layout's mapping reads from the fields of a record."""
    if layout.turns:
        array, role, text = layout.turns
        named = F.transform(got[array], lambda t: F.struct(t[role].alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
    else:
        one = []
        for role, fields in layout.parts:
            texts = [F.nullif(got[f], F.lit("")) for f in fields]
            one.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("text")))
        system = layout.parts[0][0] == "system"
        named = F.array(*one)
        if system:  # an empty system text is no turn
            named = F.when(one[0]["text"] == "", F.array(*one[1:])).otherwise(named)
    return F.transform(named, lambda t: F.struct(F.coalesce(alias[F.lower(t["role"])], t["role"], F.lit("")).alias("role"), t["text"].alias("text")))


def _readable(layout: Layout, kind: T.StructType) -> bool:
    """Whether a column of structs has the fields that a mapping reads."""
    of = {f.name: f.dataType for f in kind.fields}
    if layout.turns:
        array, role, text = layout.turns
        element = getattr(of.get(array), "elementType", None)
        return isinstance(element, T.StructType) and {role, text} <= set(element.names)
    return all(f in of for _, fs in layout.parts for f in fs)


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``layout`` and ``turns`` (array of role and text) to records, all in one pass.

    ``record_col`` holds JSON texts or structs. The nested field paths of each record are hashed, and the
    hash picks the mapping. Of a struct the fields count that hold something in its row, so one column may have the fields
    of many layouts; if these make up none, all fields of its type count, nulls as empty texts. Records of unknown layout, broken JSON and nulls get layout ``unknown`` and null
    turns, and stay; null texts become empty; fields that no mapping knows are ignored if they are scalars.
    Texts may be as long as a column can hold: paths come from a skeleton without long texts, and the texts
    from a parser without a limit. Existing columns ``layout`` and ``turns`` are replaced, all others stay.
    """
    kind = records.schema[record_col].dataType
    typed = isinstance(kind, T.StructType)
    record = F.col(record_col)
    got = record if typed else F.from_json(record, _RECORD, _JSON)
    if typed:
        mark = F.xxhash64(paths_of_row(record, kind))
        known = mark.isin(*[F.xxhash64(F.lit(lay.paths)) for lay in layouts if _readable(lay, kind)]) if any(_readable(lay, kind) for lay in layouts) else F.lit(False)
        mark = F.when(record.isNotNull(), F.when(known, mark).otherwise(F.xxhash64(F.lit(paths_of_type(kind)))))
    else:
        mark = fingerprint(record)
    got_name, mark_name = fresh(records.columns, "_got", "_fp")
    df = records.withColumns({got_name: got, mark_name: mark})
    alias = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    name, turns = F.lit("unknown"), F.lit(None).cast(f"array<{TURN}>")
    for lay in reversed(layouts):
        if typed and not _readable(lay, kind):
            continue
        hit = F.col(mark_name) == F.xxhash64(F.lit(lay.paths))
        name, turns = F.when(hit, F.lit(lay.name)).otherwise(name), F.when(hit, _turns(lay, F.col(got_name), alias)).otherwise(turns)
    return df.withColumn("layout", name).withColumn("turns", turns).drop(mark_name, got_name)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def format_turns(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` to frames with ``turns``; null turns give nulls.

    Each turn is marked as start, role, separator, text, end and a line feed. Control strings inside roles
    and texts are escaped. A loss span is [start, end) in code points of ``formatted``: the escaped text
    of one turn of a loss role, without any mark. No turns give an empty string and no spans.
    """
    (m_name,) = fresh(df.columns, "_m")
    marked = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("r"), escape(t["text"]).alias("t"), t["role"].isin(*loss_roles).alias("l")))
    formatted = F.array_join(F.transform(m_name, lambda m: F.concat(F.lit(OPEN), m["r"], F.lit(SEP), m["t"], F.lit(CLOSE + "\n"))), "")
    head, tail = len(OPEN) + len(SEP), len(CLOSE) + 1
    sums = running_sums(F.transform(m_name, lambda m: head + F.length(m["r"]) + F.length(m["t"]) + tail))

    def span(m: Column, end: Column) -> Column:
        return F.when(m["l"], F.struct((end - tail - F.length(m["t"])).alias("start"), (end - tail).alias("end")))

    spans = F.filter(F.zip_with(m_name, sums, span), lambda s: s.isNotNull())
    return df.withColumn(m_name, marked).withColumn("formatted", formatted).withColumn("loss_spans", spans).drop(m_name)


def read_back(df: DataFrame) -> DataFrame:
    """Add ``turns_back`` (role and text) and ``loss_back`` (loss texts), read from ``formatted`` and ``loss_spans`` alone.

    Spans are looked up among the pieces by sorting both by place, so nothing is walked more than once.
    """
    pieces = F.filter(F.split("formatted", "\\Q" + CLOSE + "\n\\E", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        both = lambda parts: F.struct(unescape(F.substring(parts[0], len(OPEN) + 1, 2**31 - 1)).alias("role"), unescape(parts[1]).alias("text"))
        return let(F.split(p, "\\Q" + SEP + "\\E", 2), both)

    def losses(ps: Column) -> Column:
        ends = running_sums(F.transform(ps, lambda p: F.length(p) + len(CLOSE) + 1))
        starts = F.zip_with(ps, ends, lambda p, end: F.struct((end - F.length(p) - len(CLOSE) - 1).alias("at"), F.lit(0).alias("span"), F.lit(None).cast("long").alias("n"), p.alias("piece")))
        spans = F.transform("loss_spans", lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("span"), (s["end"] - s["start"]).alias("n"), F.lit(None).cast("string").alias("piece")))
        return let(F.array_sort(F.concat(starts, spans)), lambda all_: F.filter(F.transform(all_, lambda e, i: loss(e, F.get(all_, i - 1))), lambda t: t.isNotNull()))

    def loss(e: Column, before: Column) -> Column:
        return F.when(e["span"] == 1, unescape(F.substring(before["piece"], (e["at"] - before["at"] + 1).cast("int"), e["n"].cast("int"))))

    return df.withColumn("turns_back", let(pieces, lambda ps: F.transform(ps, turn))).withColumn("loss_back", let(pieces, losses))


def records_of_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record struct(messages: array of (role, text)) for each conversation of a table of turns.

    Turns come by number, ties by role and text; repeated rows stay; null roles and texts are empty; texts
    may be of any length. Rows without a conversation id form one conversation. One conversation is the
    unit of formatting, so its turns meet in one row; no more than that ever does.
    """
    message = F.struct(F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = rows.select(F.col(id_col).alias(id_col), F.struct(F.col(turn_col).alias("n"), message.alias("m")).alias("t"))
    grouped = turns.groupBy(id_col).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return grouped.select(id_col, F.struct(F.transform("ts", lambda t: t["m"]).alias("messages")).alias("record"))


def in_many_layouts(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Records of ``records_of_rows`` told in several layouts, as tables from many sources are: one struct with the fields of all,
    of which each row fills those of its layout.

    A user's and an assistant's turn become a prompt and completion, a question and answer, or an instruction and output, in
    turn by id; with a system turn (not empty) before them a question with a system text; all else one of three message lists.
    """
    t = lambda i, f: F.get(F.col("record.messages"), F.lit(i))[f]
    roles = F.transform("record.messages", lambda m: m["role"])
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    triple = (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (t(0, "text") != "")
    turn = F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(3))
    rest = ~pair & ~triple
    renamed = lambda role, text: F.transform("record.messages", lambda m: F.struct(m["role"].alias(role), m["text"].alias(text)))
    fields = {
        "messages": F.when(rest & (turn == 0), F.col("record.messages")),
        "turns": F.when(rest & (turn == 1), renamed("role", "content")),
        "conversations": F.when(rest & (turn == 2), renamed("from", "value")),
        "prompt": F.when(pair & (turn == 0), t(0, "text")),
        "completion": F.when(pair & (turn == 0), t(1, "text")),
        "system": F.when(triple, t(0, "text")),
        "question": F.when(triple, t(1, "text")).when(pair & (turn == 1), t(0, "text")),
        "answer": F.when(triple, t(2, "text")).when(pair & (turn == 1), t(1, "text")),
        "instruction": F.when(pair & (turn == 2), t(0, "text")),
        "output": F.when(pair & (turn == 2), t(1, "text")),
    }
    return records.select(id_col, F.struct(*[c.alias(n) for n, c in fields.items()]).alias("record"))


def chat_digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The contract's digest of formatted conversations, read back from the formatted text and its loss spans."""
    back = read_back(formatted)
    lines = F.transform("turns_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_back", "")
    return back.select(
        id_col,
        F.size("turns_back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
