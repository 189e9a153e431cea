"""Chat formatting: a small sandboxed template language compiled to Python closures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm.common import read_table

#: Marks every turn by its role and an end; ``escape`` keeps control strings in texts apart.
TEMPLATE = (
    "{% for message in messages %}### {{ message.role | escape_role | capitalize }}: "
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ ' ' ~ '</turn>' ~ '\n' }}{% endfor %}"
)


class TemplateError(ValueError):
    """The template is not part of the language."""


# --- filters: the only functions a template can call ---------------------------------------------

def _escape(value: str) -> str:
    """``#``, ``<`` and the backslash get a backslash, so no control string is left in a text."""
    return re.sub(r"([\\#<])", r"\\\1", value)


def unescape(value: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", value)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": _escape,
    "escape_role": lambda value: re.sub(r"([\\#<:A-Z])", r"\\\1", value),
    "capitalize": lambda value: value[:1].upper() + value[1:] if "a" <= value[:1] <= "z" else value,
    "upper": str.upper,
    "lower": str.lower,
    "trim": str.strip,
}

# --- syntax tree ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Filter:
    inner: object
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass
class Output:
    value: object


@dataclass
class For:
    name: str
    source: Name
    body: list


@dataclass
class If:
    test: object
    body: list
    other: list


@dataclass
class Generation:
    body: list


@dataclass
class _Tokens:
    items: list[tuple[str, str]]
    at: int = 0
    text: str = field(default="")

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if value is not None and token[1] != value or token[0] == "end" and value is None:
            raise TemplateError(f"{value or 'more'} expected in {self.text!r}")
        self.at += 1
        return token


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|.()]))")
_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(text: str) -> _Tokens:
    items, at, text = [], 0, text.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise TemplateError(f"unknown characters in {text!r}")
        string, number, name, sign = found.groups()
        if string is not None:
            items.append(("string", re.sub(r"(?s)\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), string[1:-1])))
        else:
            items.append(("number", number) if number else ("name", name) if name else ("sign", sign))
        at = found.end()
    return _Tokens(items, 0, text)


def _expression(tokens: _Tokens, level: int = 0):
    """or, and, not, comparison, ``~``, filters: in rising strength."""
    if level in (0, 1):
        word = ("or", "and")[level]
        left = _expression(tokens, level + 1)
        while tokens.peek() == ("name", word):
            tokens.take()
            left = Binary(word, left, _expression(tokens, level + 1))
        return left
    if level == 2:
        if tokens.peek() == ("name", "not"):
            tokens.take()
            return Not(_expression(tokens, 2))
        left = _expression(tokens, 3)
        while tokens.peek() in (("sign", "=="), ("sign", "!=")):
            left = Binary(tokens.take()[1], left, _expression(tokens, 3))
        return left
    if level == 3:
        left = _expression(tokens, 4)
        while tokens.peek() == ("sign", "~"):
            tokens.take()
            left = Binary("~", left, _expression(tokens, 4))
        return left
    kind, value = tokens.take()
    if kind == "string":
        node: object = Const(value)
    elif kind == "number":
        node = Const(int(value))
    elif kind == "name" and value in ("true", "false"):
        node = Const(value == "true")
    elif kind == "name":
        path = [value]
        while tokens.peek() == ("sign", "."):
            tokens.take()
            path.append(tokens.take()[1])
        if any(part.startswith("_") for part in path):
            raise TemplateError(f"{'.'.join(path)}: names may not begin with an underscore")
        node = Name(tuple(path))
    elif value == "(":
        node = _expression(tokens)
        tokens.take(")")
    else:
        raise TemplateError(f"{value!r} in {tokens.text!r}")
    while tokens.peek() == ("sign", "|"):
        tokens.take()
        name = tokens.take()[1]
        if name not in FILTERS:
            raise TemplateError(f"no filter {name}")
        node = Filter(node, name)
    return node


def parse(template: str) -> list:
    """The syntax tree. Names are looked up in the given data only: no calls, attributes of objects or imports."""
    stack: list[tuple[str, list, object]] = [("", [], None)]
    for part in _PARTS.split(template):
        if part.startswith("{{"):
            tokens = _tokens(part[2:-2])
            stack[-1][1].append(Output(_expression(tokens)))
        elif part.startswith("{%"):
            tokens = _tokens(part[2:-2])
            word = tokens.take()[1]
            if word == "for":
                name = tokens.take()[1]
                tokens.take("in")
                source = _expression(tokens)
                if not isinstance(source, Name):
                    raise TemplateError("for needs a name to go over")
                stack.append(("for", [], (name, source)))
            elif word == "if":
                stack.append(("if", [], _expression(tokens)))
            elif word == "else" and stack[-1][0] == "if":
                stack.append(("else", [], None))
            elif word == "generation":
                stack.append(("generation", [], None))
            elif word == "endfor" and stack[-1][0] == "for":
                _, body, (name, source) = stack.pop()
                stack[-1][1].append(For(name, source, body))
            elif word == "endif" and stack[-1][0] in ("if", "else"):
                other = stack.pop()[1] if stack[-1][0] == "else" else []
                _, body, test = stack.pop()
                stack[-1][1].append(If(test, body, other))
            elif word == "endgeneration" and stack[-1][0] == "generation":
                stack[-2][1].append(Generation(stack.pop()[1]))
            else:
                raise TemplateError(f"{word} is out of place")
        elif part:
            stack[-1][1].append(Output(Const(part)))
            continue
        else:
            continue
        if tokens.peek()[0] != "end":
            raise TemplateError(f"too much in {part!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return stack[0][1]


def _apply(op: str, left, right):
    return {"==": left == right, "!=": left != right, "~": f"{left}{right}", "or": left or right, "and": left and right}[op]


def fold(node):
    """Constants worked out: expressions of constants, tests with a known result, neighbouring texts."""
    match node:
        case list():
            flat: list = []
            for child in map(fold, node):
                known = isinstance(child, If) and isinstance(child.test, Const)
                flat += (child.body if child.test.value else child.other) if known else [child]
            out: list = []
            for child in flat:
                both = [x.value for x in (*out[-1:], child) if isinstance(x, Output) and isinstance(x.value, Const)]
                if len(both) == 2:
                    out[-1] = Output(Const(f"{both[0].value}{both[1].value}"))
                else:
                    out.append(child)
            return out
        case Output(value):
            return Output(fold(value))
        case For(name, source, body):
            return For(name, source, fold(body))
        case If(test, body, other):
            return If(fold(test), fold(body), fold(other))
        case Generation(body):
            return Generation(fold(body))
        case Filter(inner, name):
            inner = fold(inner)
            return Const(FILTERS[name](str(inner.value))) if isinstance(inner, Const) else Filter(inner, name)
        case Not(inner):
            inner = fold(inner)
            return Const(not inner.value) if isinstance(inner, Const) else Not(inner)
        case Binary(op, left, right):
            left, right = fold(left), fold(right)
            if isinstance(left, Const) and isinstance(right, Const):
                return Const(_apply(op, left.value, right.value))
            return Binary(op, left, right)
    return node


def _value(node) -> Callable[[dict], object]:
    match node:
        case Const(value):
            return lambda scope: value
        case Name((first, *rest)):
            def look(scope: dict):
                found = scope.get(first, "")
                for part in rest:
                    found = found.get(part, "") if isinstance(found, dict) else ""
                return "" if found is None else found
            return look
        case Filter(inner, name):
            inside, function = _value(inner), FILTERS[name]
            return lambda scope: function(str(inside(scope)))
        case Not(inner):
            inside = _value(inner)
            return lambda scope: not inside(scope)
        case Binary(op, left, right):
            one, two = _value(left), _value(right)
            return lambda scope: _apply(op, one(scope), two(scope))
    raise TemplateError(f"no expression: {node!r}")


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _block(nodes: list) -> Render:
    steps = [_statement(node) for node in nodes]

    def run(scope: dict, masked: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope, masked)

    return run


def _statement(node) -> Render:
    match node:
        case Output(Const(value)):
            text = str(value)
            return lambda scope, masked: iter(((text, masked),))
        case Output(value):
            get = _value(value)
            return lambda scope, masked: iter(((str(get(scope)), masked),))
        case For(name, source, body):
            items, inner = _value(source), _block(body)

            def loop(scope: dict, masked: bool) -> Iterator[tuple[str, bool]]:
                for item in items(scope) or ():
                    yield from inner({**scope, name: item}, masked)

            return loop
        case If(test, body, other):
            check, yes, no = _value(test), _block(body), _block(other)
            return lambda scope, masked: (yes if check(scope) else no)(scope, masked)
        case Generation(body):
            inner = _block(body)
            return lambda scope, masked: inner(scope, True)
    raise TemplateError(f"no statement: {node!r}")


def compile_template(template: str = TEMPLATE) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A function from data to pieces (text, is it generated); pieces come as they are rendered."""
    render = _block(fold(parse(template)))
    return lambda data: render(data, False)


# --- reading the output back ----------------------------------------------------------------------

_TURN = re.compile(r"### ((?:[^\\:#<]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.DOTALL)


def read_role(shown: str) -> str:
    """The role behind a heading: an upper-case letter without a backslash was made so by the template."""
    return unescape(shown[:1].lower() + shown[1:])


def read_turns(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the mask, length) of each turn of a formatted conversation, piece by piece."""
    shown: list[str] = []
    masked: list[str] = []
    for text, generated in pieces:
        shown.append(text)
        if generated:
            masked.append(text)
        if text.endswith(" </turn>\n"):  # in escaped texts a backslash stands before "<"
            whole = "".join(shown)
            found = _TURN.fullmatch(whole)
            if not found:
                raise ValueError(f"no turn: {whole[:80]!r}")
            yield read_role(found[1]), unescape(found[2]), unescape("".join(masked)), len(whole)
            shown, masked = [], []
    if shown:
        raise ValueError("the last turn is not closed")


# --- conversations in Spark -----------------------------------------------------------------------

_EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows of a conversation side by side in one task, by turn; ties by role and text; nulls as empty."""
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[dict]]]:
    """The sorted rows as one lazy iterator of messages for each conversation."""
    rows = ((c, r, t) for frame in frames for c, r, t in zip(frame.conv_id, frame.role, frame.text, strict=True))
    state = {"next": next(rows, None)}

    def same(a, b) -> bool:
        return a == b or pd.isna(a) and pd.isna(b)

    def messages(conv) -> Iterator[dict]:
        while state["next"] is not None and same(state["next"][0], conv):
            yield {"role": state["next"][1], "text": state["next"][2]}
            state["next"] = next(rows, None)

    while state["next"] is not None:
        conv = state["next"][0]
        turns = messages(conv)
        yield conv, turns
        for _ in turns:  # what the template has left
            pass


def format_turns(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, piece, text, generated: the formatted conversations, as numbered pieces.

    A conversation is rendered while its sorted rows pass by, so one of any length needs the memory of
    one message; a template can therefore go over the messages once. Pieces of a conversation, put together by number, are its formatted text, and those with
    ``generated`` its loss mask. Turns with equal numbers are all kept, ordered by role and text; null
    turns come first; null roles and texts are empty; rows with a null conv_id are one conversation.
    Other columns are not carried and may have any name; an empty table gives none.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render, out = compile_template(template), []
        for conv, messages in _conversations(frames):
            for number, (text, generated) in enumerate(render({"messages": messages})):
                out.append((None if pd.isna(conv) else int(conv), number, text, generated))
                if len(out) >= 2000:
                    yield _frame(out, ["conv_id", "piece", "text", "generated"])
                    out = []
        if out:
            yield _frame(out, ["conv_id", "piece", "text", "generated"])

    return _ordered(rows).mapInPandas(run, "conv_id long, piece long, text string, generated boolean")


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})


def read_back(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per conversation what its formatted text says, rendered and read again as the rows pass by.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; cases as in ``format_turns``.
    """
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render, out = compile_template(template), []
        for conv, messages in _conversations(frames):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for role, text, masked, length in read_turns(render({"messages": messages})):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(masked.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + length
            out.append((None if pd.isna(conv) else int(conv), n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 2000:
                yield _frame(out, columns)
                out = []
        if out:
            yield _frame(out, columns)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _ordered(rows).mapInPandas(run, schema)


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.createDataFrame(_EXTRA, "conv_id long, turn long, role string, text string")
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(rows.unionByName(extra))


SQL = r"""
WITH everything AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
lengths AS (
    SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
           length(regexp_replace(role, '([\\#<:A-Z])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 15 AS shown
    FROM everything)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM lengths GROUP BY conv_id
"""
