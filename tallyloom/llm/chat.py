"""Chat formatting with a small sandboxed template language.

A template is parsed into a syntax tree, constants in it are folded, and the tree becomes Python closures: generators that
yield pieces of text, each marked as generated (inside `{% generation %}`) or not.

    {{ expression }}   {% for m in messages %} .. {% endfor %}   {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% generation %} .. {% endgeneration %}

Expressions: string and integer literals, variables, m.role, m.text, loop.index / first, filters (|), +, ==, !=, and, or,
not, parentheses.  There are no calls, subscripts or other attributes, so a template reaches nothing but its inputs.

Conversations are sorted by turn within their partition and rendered as a stream in pieces of about CHUNK characters, so a
conversation of any length is never held whole.  (Its digests are made by one task, as a digest is sequential.)

Defined cases: null roles and texts are empty; null turns come first; equal turns are in the order of role and text;
repeated rows are repeated turns; a null conv_id is a conversation; empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .line_dedup import NO_ID

CHUNK = 1_000_000

# -- escaping -----------------------------------------------------------------------------------------------------------

TURN, COLON, END = "### ", ": ", "</turn>\n"
_TEXT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE = re.compile(r"[\\:#<]")
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Puts a backslash before backslashes and before the first character of each control string."""
    return _TEXT.sub(lambda m: "\\" + m[0], text)


def escape_name(text: str) -> str:
    return _ROLE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "name": escape_name, "upper": str.upper, "lower": str.lower, "trim": str.strip}
ATTRIBUTES = {"role", "text", "index", "first"}

# -- syntax tree --------------------------------------------------------------------------------------------------------

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKENS = re.compile(r"""\s*(?:("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[|+().]))""")
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; the tree is nested tuples: ("const", v), ("var", name), ("attr", e, name) ..."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def parse(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.summed()
        if op := self.take("==", "!="):
            tree = (op, tree, self.summed())
        return tree

    def summed(self):
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            name = self.tokens[self.at] if self.at < len(self.tokens) else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", tree, name)
        return tree

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        token = self.tokens[self.at]
        self.at += 1
        if token == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
        elif token[0] in "\"'":
            tree = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1]))
        elif token.isdigit():
            tree = ("const", int(token))
        elif token.isidentifier():
            tree = ("var", token)
        else:
            raise TemplateError(f"unexpected {token!r}")
        while self.take("."):
            name = self.tokens[self.at] if self.at < len(self.tokens) else ""
            if name not in ATTRIBUTES:
                raise TemplateError(f"no attribute {name!r}")
            self.at += 1
            tree = ("attr", tree, name)
        return tree


def parse(template: str):
    """The tree of a template: ("seq", [nodes]) of text, out, for, if and generation nodes."""
    stack = [("top", [])]
    at = 0
    for m in _PARTS.finditer(template):
        if m.start() > at:
            stack[-1][1].append(("text", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("out", _Expression(m[1]).parse()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            name = re.fullmatch(r"([A-Za-z_]\w*) in messages", rest.strip())
            if not name:
                raise TemplateError("only `for x in messages`")
            stack.append(("for", [], name[1]))
        elif word == "if":
            stack.append(("if", [], _Expression(rest).parse(), []))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            _, body, test, done = stack.pop()
            stack.append(("if", [], _Expression(rest).parse() if word == "elif" else ("const", 1), [*done, (test, ("seq", body))]))
        elif word == "generation":
            stack.append(("generation", []))
        elif word.startswith("end") and stack[-1][0] == word[3:]:
            kind, body, *more = stack.pop()
            node = {"for": lambda: ("for", *more, ("seq", body)), "if": lambda: ("if", [*more[1], (more[0], ("seq", body))]), "generation": lambda: ("generation", ("seq", body))}[kind]()
            stack[-1][1].append(node)
        else:
            raise TemplateError(f"unexpected {m[2].strip()!r}")
    if at < len(template):
        stack[-1][1].append(("text", template[at:]))
    if len(stack) > 1:
        raise TemplateError(f"missing end{stack[-1][0]}")
    return ("seq", stack[0][1])


def fold(node):
    """The tree with constant expressions evaluated, decided branches taken and neighbouring texts joined."""
    kind = node[0]
    if kind == "out":
        inner = fold(node[1])
        return ("text", str(inner[1])) if inner[0] == "const" else ("out", inner)
    if kind == "seq":
        out: list = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "seq" else [x]:
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return ("seq", out)
    if kind == "if":
        arms = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            arms.append((test, fold(body)))
            if test[0] == "const":
                break
        return ("seq", []) if not arms else arms[0][1] if arms[0][0][0] == "const" else ("if", arms)
    if kind in ("for", "generation"):
        return (*node[:-1], fold(node[-1]))
    if kind in ("text", "const", "var"):
        return node
    if kind in ("filter", "attr"):
        inner = fold(node[1])
        return ("const", FILTERS[node[2]](str(inner[1]))) if kind == "filter" and inner[0] == "const" else (kind, inner, node[2])
    parts = [fold(x) for x in node[1:]]
    return ("const", _value((kind, *parts))({})) if all(x[0] == "const" for x in parts) else (kind, *parts)


# -- closures -----------------------------------------------------------------------------------------------------------


def _value(node) -> Callable:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "var":
        return lambda scope, k=node[1]: scope[k]
    if kind == "attr":
        inner = _value(node[1])
        return lambda scope, k=node[2]: inner(scope)[k]
    if kind == "filter":
        inner, f = _value(node[1]), FILTERS[node[2]]
        return lambda scope: f(str(inner(scope)))
    a, *rest = map(_value, node[1:])
    if kind == "not":
        return lambda scope: not a(scope)
    (b,) = rest
    return {
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "+": lambda scope: _sum(a(scope), b(scope)),
    }[kind]


def _sum(x, y):
    """Numbers add up, all else is joined as text; both values are there once, so a chain of n terms costs n."""
    return x + y if isinstance(x, int) and isinstance(y, int) else str(x) + str(y)


def _writer(node, generated: bool = False) -> Callable:
    kind = node[0]
    if kind == "text":
        pieces = ((node[1], generated),)
        return lambda scope: pieces
    if kind == "out":
        value = _value(node[1])
        return lambda scope: ((str(value(scope)), generated),)
    if kind == "generation":
        return _writer(node[1], True)
    if kind == "if":
        arms = [(_value(t), _writer(b, generated)) for t, b in node[1]]
        return lambda scope: next((body(scope) for test, body in arms if test(scope)), ())
    if kind == "for":
        name, body = node[1], _writer(node[2], generated)

        def loop(scope):
            for i, message in enumerate(scope["messages"]):
                yield from body({**scope, name: message, "loop": {"index": i + 1, "first": i == 0}})

        return loop
    parts = [_writer(x, generated) for x in node[1]]

    def sequence(scope):
        for part in parts:
            yield from part(scope)

    return sequence


def compile_template(template: str) -> Callable[[Iterator[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (dicts with role and text, read once) to pieces (text, generated)."""
    writer = _writer(fold(parse(template)))
    return lambda messages: iter(writer({"messages": messages}))


TEMPLATE = (
    "{% for m in messages %}{{ '### ' + (m.role | name) + ': ' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '</turn>' }}\n{% endfor %}"
)

# -- conversations ------------------------------------------------------------------------------------------------------


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, chunk, text, starts, ends): the formatted conversations in numbered chunks; starts and ends delimit the loss mask in them."""
    parse(template)  # errors show here, not in a task
    rows = turns.select(F.coalesce(F.col(conv).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        render = compile_template(template)
        stream = ((c, r, t) for pdf in batches for c, r, t in zip(pdf["conv"], pdf["role"], pdf["text"]))
        for c, own in groupby(stream, key=lambda x: x[0]):
            chunk, held, size, starts, ends = 0, [], 0, [], []
            for piece, generated in render({"role": r, "text": t} for _, r, t in own):
                if generated and piece:
                    starts.append(size)
                    ends.append(size + len(piece))
                held.append(piece)
                size += len(piece)
                if size >= CHUNK:
                    yield pd.DataFrame({"conv": [c], "chunk": [chunk], "text": ["".join(held)], "starts": [starts], "ends": [ends]})
                    chunk, held, size, starts, ends = chunk + 1, [], 0, [], []
            yield pd.DataFrame({"conv": [c], "chunk": [chunk], "text": ["".join(held)], "starts": [starts], "ends": [ends]})

    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text").mapInPandas(run, "conv long, chunk int, text string, starts array<int>, ends array<int>")


def _end_of(text: str, mark: str, at: int) -> int:
    """Where the next `mark` without an escape before it begins, or -1."""
    while (at := text.find(mark, at)) >= 0:
        back = at
        while back and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at += 1
    return -1


def read_turns(chunks: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read back from the chunks of one conversation."""
    buffer = ""
    for chunk in chunks:
        buffer, at = buffer + chunk, 0
        while (end := _end_of(buffer, END, at)) >= 0:
            colon = _end_of(buffer, COLON, at + len(TURN))
            if not buffer.startswith(TURN, at) or colon < 0 or colon > end:
                raise ValueError("not a formatted turn")
            yield unescape(buffer[at + len(TURN) : colon]), unescape(buffer[colon + len(COLON) : end])
            at = end + len(END)
        buffer = buffer[at:]
    if buffer:
        raise ValueError("a turn has no end")


def digest_conversations(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from format_conversations()."""

    def run(batches):
        stream = (row for pdf in batches for row in zip(pdf["conv"], pdf["text"], pdf["starts"], pdf["ends"]))
        for c, own in groupby(stream, key=lambda x: x[0]):
            turns, loss, n, chars, masked = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def chunks():
                nonlocal chars, masked
                for _, text, starts, ends in own:
                    chars += len(text)
                    for a, b in zip(starts, ends):
                        part = unescape(text[a:b])
                        masked += len(part)
                        loss.update(part.encode("utf-8", "surrogatepass"))
                    yield text

            for role, text in read_turns(chunks()):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            yield pd.DataFrame({"conv": [c], "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [masked], "loss_sha256": [loss.hexdigest()], "formatted_chars": [chars]})

    out = formatted.repartition("conv").sortWithinPartitions("conv", "chunk").select("conv", "text", "starts", "ends").mapInPandas(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias(conv), *out.columns[1:])


TRICKY = r"\### Assistant: </turn> ok"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    return digest_conversations(cut(format_conversations(turns.unionByName(own))))


QUERIES = {"op4_chat_format": op4_chat_format}
ORACLE_SQL = {
    "op4_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length('### ' || ': </turn>' || chr(10)) + length(role) + length(text)
    + length(role) - length(regexp_replace(role, '[\\:#<]', '', 'g'))
    + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
}
