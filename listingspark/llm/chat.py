"""Chat records of many layouts as canonical turns and formatted training text, in built-in functions alone.

*Layouts.*  A record is a JSON text.  Which of the known nested field paths it has is hashed; the hash picks
a declarative mapping to turns.  Fields that no mapping knows don't count, whatever their names.  A record
without a known layout (or that is no JSON) has ``layout`` null and no turns.

*Template.*  A turn is ``<|turn|>role\\ntext<|end|>\\n``.  Control strings inside roles and texts, of this
template and of others in use, get a backslash after their first character, and strings that look escaped
already get one more, so reading takes exactly one away.  In a role a percent sign and a line feed are ``%25``
and ``%0A``.  ``loss_spans`` are the places of assistant texts in the formatted text, in code points.

A null role is the empty role, a null text the empty text; turns keep their order, repeated ones too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from listingspark.stages import once_sql


@dataclass(frozen=True)
class Mapping:
    """Paths that a layout has, and the SQL of its turns over the parsed record ``v``."""

    name: str
    paths: tuple[str, ...]
    turns: str


def _text(path: str) -> str:
    return f"coalesce(try_variant_get(v, '{path}', 'string'), '')"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


def _list(path: str, role: str, text: str) -> str:
    """Turns of a list of objects; the names that shared conversations use for the two sides are renamed."""
    items = f"coalesce(try_variant_get(v, '{path}', 'array<struct<`{role}`: string, `{text}`: string>>'), array())"
    name = f"coalesce(t.`{role}`, '')"
    if role == "from":
        name = f"CASE {name} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE {name} END"
    return f"transform({items}, t -> named_struct('role', {name}, 'text', coalesce(t.`{text}`, '')))"


def _pair(question: str, answer: str, system: str | None = None) -> str:
    turns = [_turn("system", _text(system))] if system else []
    return f"array({', '.join([*turns, _turn('user', question), _turn('assistant', _text(answer))])})"


_BOTH = f"concat_ws('\\n\\n', nullif({_text('$.instruction')}, ''), nullif({_text('$.input')}, ''))"
MAPPINGS = [
    Mapping("messages", ("$.messages", "$.messages[0].role", "$.messages[0].content"), _list("$.messages", "role", "content")),
    Mapping("no messages", ("$.messages",), "CAST(array() AS array<struct<role: string, text: string>>)"),
    Mapping("conversations", ("$.conversations", "$.conversations[0].from", "$.conversations[0].value"), _list("$.conversations", "from", "value")),
    Mapping("no conversations", ("$.conversations",), "CAST(array() AS array<struct<role: string, text: string>>)"),
    Mapping("prompt and completion", ("$.prompt", "$.completion"), _pair(_text("$.prompt"), "$.completion")),
    Mapping("prompt and response", ("$.prompt", "$.response"), _pair(_text("$.prompt"), "$.response")),
    Mapping("question and answer", ("$.question", "$.answer"), _pair(_text("$.question"), "$.answer")),
    Mapping("instruction", ("$.instruction", "$.output"), _pair(_text("$.instruction"), "$.output")),
    Mapping("instruction with input", ("$.instruction", "$.input", "$.output"), _pair(_BOTH, "$.output")),
    Mapping("system and instruction", ("$.system", "$.instruction", "$.output"), _pair(_text("$.instruction"), "$.output", "$.system")),
    Mapping("system, instruction and input", ("$.system", "$.instruction", "$.input", "$.output"), _pair(_BOTH, "$.output", "$.system")),
]
_PATHS = sorted({p for m in MAPPINGS for p in m.paths})

# Strings that chat templates in use give a meaning.
_CONTROL = r"\\|[A-Za-z0-9_]+\\|>|/?s>|/?INST\\]|</?SYS>>"
_TURN, _END = "<|turn|>", "<|end|>\\n"


def escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\\[])(\\\\*)({_CONTROL})', '$1\\\\$2$3')"


def unescaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\\[])\\\\(\\\\*)({_CONTROL})', '$1$2$3')"


def _role(role: str) -> str:
    return f"replace(replace({escaped(role)}, '%', '%25'), '\\n', '%0A')"


def _unrole(role: str) -> str:
    return unescaped(f"replace(replace({role}, '%0A', '\\n'), '%25', '%')")


def canonical_turns(records: DataFrame, json_col: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``layout``, ``schema_hash`` and ``turns``: an array of role and text.  Kept columns with these names give way."""
    keep = tuple(c for c in keep if c not in ("layout", "schema_hash", "turns"))
    df = records.select(*[records[c].alias(f"_k{i}") for i, c in enumerate(keep)], F.try_parse_json(records[json_col]).alias("v"))
    present = ", ".join(f"IF(try_variant_get(v, '{p}', 'variant') IS NULL, NULL, '{p}')" for p in _PATHS)
    df = once_sql(df, {"schema_hash": f"xxhash64(concat_ws('|', {present}))"})
    known = [(f"schema_hash = xxhash64('{'|'.join(sorted(m.paths))}')", m) for m in MAPPINGS]
    layout = "CASE " + " ".join(f"WHEN {c} THEN '{m.name}'" for c, m in known) + " END"
    turns = "CASE " + " ".join(f"WHEN {c} THEN {m.turns}" for c, m in known) + " ELSE CAST(array() AS array<struct<role: string, text: string>>) END"
    df = once_sql(df, {"layout": layout, "turns": turns})
    return df.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "layout", "schema_hash", "turns")


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (start from 0 and length of each assistant text, escaped)."""
    df = once_sql(df, {"_parts": f"transform({turns}, t -> named_struct('role', t.role, 'head', '{_TURN}' || {_role('t.role')} || '\\n', 'text', {escaped('t.text')}))"})
    zero = "named_struct('at', 0, 'spans', CAST(array() AS array<struct<start: int, length: int>>))"
    step = (f"(a, p) -> named_struct('at', a.at + char_length(p.head) + char_length(p.text) + {len(_END.replace(chr(92) + 'n', chr(10)))}, 'spans', "
            "IF(p.role = 'assistant', concat(a.spans, array(named_struct('start', a.at + char_length(p.head), 'length', char_length(p.text)))), a.spans))")
    return once_sql(df, {"formatted": f"array_join(transform(_parts, p -> concat(p.head, p.text, '{_END}')), '')",
                         "loss_spans": f"aggregate(_parts, {zero}, {step}, a -> a.spans)"}).drop("_parts")


def read_turns(formatted: str) -> str:
    """SQL of the turns in a formatted text."""
    end = r"<\\|end\\|>\\n"
    body = f"substring(p, {len(_TURN) + 1})"
    return (f"transform(filter(split({formatted}, '{end}'), p -> p <> ''), p -> named_struct('role', {_unrole(f'''substring_index({body}, '\\n', 1)''')}, "
            f"'text', {unescaped(f'''substring({body}, locate('\\n', {body}) + 1)''')}))")


def read_loss(formatted: str, spans: str) -> str:
    """SQL of the assistant texts under the loss mask, unescaped."""
    return f"transform({spans}, s -> {unescaped(f'substring({formatted}, s.start + 1, s.length)')})"


def records_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as one JSON record per conversation, in the layout that suits its roles.

    Turns are in order of their number, ties by role and text; a null number comes first.
    """
    rows = turns.select(turns[conv_col].alias("conv_id"), F.struct(
        turns[turn_col].cast("long").alias("turn"), F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text")).alias("t"))
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).withColumn("roles", F.expr("transform(ts, t -> t.role)"))
    record = """CASE
        WHEN roles = array('user', 'assistant') THEN to_json(named_struct('prompt', ts[0].text, 'completion', ts[1].text))
        WHEN roles = array('system', 'user', 'assistant') THEN to_json(named_struct('system', ts[0].text, 'instruction', ts[1].text, 'output', ts[2].text))
        WHEN conv_id % 2 = 0 AND NOT arrays_overlap(roles, array('human', 'gpt'))
            THEN to_json(named_struct('conversations', transform(ts, t -> named_struct('from', CASE t.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE t.role END, 'value', t.text))))
        ELSE to_json(named_struct('messages', transform(ts, t -> named_struct('role', t.role, 'content', t.text)))) END"""
    return df.select("conv_id", F.expr(record).alias("record"))


def oracle() -> str:
    """Digests of the turns and of the assistant texts over ``conversations`` in another engine."""
    control = _CONTROL.replace("\\\\", "\\")
    esc = lambda c: rf"regexp_replace({c}, '([<\[])(\\*)({control})', '\1\\\2\3', 'g')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace({esc('role')}, '%', '%25'), chr(10), '%0A') AS erole, {esc('text')} AS etext FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('{_TURN}') + length(erole) + 1 + length(etext) + {len(_END) - 1}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
