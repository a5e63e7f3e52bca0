"""The object select language: one table, a projection, a filter and a limit.

A statement is parsed into a small tree and built into Catalyst expressions, so
filters reach the scan and columns are pruned.  Two modes:

``standard``  SQL semantics: three-valued logic, escaped LIKE, aliases, NOT, CASE,
              CAST, ILIKE and a few functions.
``compat``    the semantics of dynamically typed rows: NULL equals NULL, values of
              different types are unequal, ordering needs two numbers or two
              strings, arithmetic is in doubles, AND/OR need two booleans, LIKE
              patterns are regular expressions with ``%`` and ``_`` replaced, and an
              expression without a value ("missing") rejects the row; NOT, minus signs,
              CASE, CAST, functions and ILIKE never have one.

A request names the statement and the formats of its input and output, as JSON or XML.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\")|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<op><>|!=|<=|>=|\|\||[-+*/%=<>(),;.]))"
)
_RESERVED = {"select", "from", "where", "limit", "and", "or", "not", "is", "null", "in", "between", "like", "escape", "as", "true", "false", "case", "when", "then", "else", "end", "cast", "ilike", "similar", "exists"}


class SelectError(ValueError):
    """A statement that the select language does not have."""


@dataclass(frozen=True)
class Node:
    """An expression: an operator and its operands, or a value."""

    op: str
    args: tuple = ()


@dataclass
class Query:
    """What a statement asks for; ``columns`` is None for ``*``."""

    columns: list[tuple[Node, str]] | None
    where: Node | None = None
    limit: int | None = None


class _Parser:
    def __init__(self, sql: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(sql.rstrip()):
            m = _TOKEN.match(sql, at)
            if not m:
                raise SelectError(f"unexpected text at {sql[at:at + 20]!r}")
            kind = m.lastgroup or ""
            text = m[kind]
            self.tokens.append(("word", text.lower()) if kind == "word" and text.lower() in _RESERVED else (kind if kind != "word" else "name", text))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "op") and self.tokens[self.at][1] in texts

    def take(self, *texts: str) -> str | None:
        if self.peek(*texts):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SelectError(f"expected {text.upper()}")

    def query(self) -> Query:
        self.need("select")
        columns: list[tuple[Node, str]] = []
        star = False
        while True:
            if self.take("*"):
                star = True
            else:
                begin = self.at
                node = self.expression()
                name = node.args[0] if node.op == "column" else "".join(t for _, t in self.tokens[begin : self.at])
                if self.take("as") or (self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "quoted")):
                    name = self.name()
                columns.append((node, name))
            if not self.take(","):
                break
        self.need("from")
        self.name()
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.name()  # a table alias
        out = Query(None if star else columns)
        if self.take("where"):
            out.where = self.expression()
        if self.take("limit"):
            kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind == "number" and text.isdigit():
                out.limit = int(text)
            self.at += 1
        # Only the first statement counts.
        if self.at < len(self.tokens) and not self.peek(";"):
            raise SelectError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "end")
        if kind == "name":
            self.at += 1
            return text
        if kind == "quoted":
            self.at += 1
            return text[1:-1].replace('""', '"')
        raise SelectError(f"expected a name, not {text!r}")

    def expression(self) -> Node:
        left = self.conjunction()
        while self.take("or"):
            left = Node("or", (left, self.conjunction()))
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.take("and"):
            left = Node("and", (left, self.negation()))
        return left

    def negation(self) -> Node:
        return Node("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        left = self.sum()
        while True:
            if op := self.take("=", "<>", "!=", "<", "<=", ">", ">="):
                left = Node("<>" if op == "!=" else op, (left, self.sum()))
            elif self.take("is"):
                negated = bool(self.take("not"))
                self.need("null")
                left = Node("is not null" if negated else "is null", (left,))
            else:
                begin = self.at
                negated = bool(self.take("not"))
                if self.take("in"):
                    self.need("(")
                    items = [self.sum()]
                    while self.take(","):
                        items.append(self.sum())
                    self.need(")")
                    left = Node("not in" if negated else "in", (left, *items))
                elif self.take("between"):
                    low = self.sum()
                    self.need("and")
                    left = Node("not between" if negated else "between", (left, low, self.sum()))
                elif self.take("ilike"):
                    left = Node("ilike", (left, self.sum()))
                    left = Node("not", (left,)) if negated else left
                elif self.take("similar"):
                    if self.name().lower() != "to":
                        raise SelectError("expected TO")
                    left = Node("unsupported", (left, self.sum()))
                elif self.take("like"):
                    pattern = self.sum()
                    escape = self.sum() if self.take("escape") else None
                    left = Node("not like" if negated else "like", (left, pattern, escape))
                else:
                    self.at = begin
                    return left

    def sum(self) -> Node:
        left = self.product()
        while op := self.take("+", "-", "||"):
            left = Node(op, (left, self.product()))
        return left

    def product(self) -> Node:
        left = self.unary()
        while op := self.take("*", "/", "%"):
            left = Node(op, (left, self.unary()))
        return left

    def unary(self) -> Node:
        if self.take("-"):
            return Node("negative", (self.unary(),))
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        if self.take("null"):
            return Node("literal", (None,))
        if self.take("case"):
            return self.case()
        if self.take("cast"):
            self.need("(")
            value = self.expression()
            self.need("as")
            kind = self.name().lower()
            if self.take("("):
                while not self.take(")"):
                    self.at += 1
            self.need(")")
            return Node("cast", (value, kind))
        if self.take("exists"):
            self.need("(")
            depth = 1
            while depth and self.at < len(self.tokens):
                depth += 1 if self.take("(") else -1 if self.take(")") else self.skip()
            return Node("unsupported", ())
        if word := self.take("true", "false"):
            return Node("literal", (word == "true",))
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "end")
        if kind == "number":
            self.at += 1
            return Node("literal", (int(text) if text.isdigit() else float(text),))
        if kind == "string":
            self.at += 1
            return Node("literal", (text[1:-1].replace("''", "'"),))
        quoted = kind == "quoted"
        name = self.name()
        if not quoted and self.take("("):
            args: list[Node] = []
            while not self.take(")"):
                args.append(self.expression())
                if not self.peek(")"):
                    self.need(",")
            return Node("call", (name.lower(), *args))
        if self.take("."):
            name = self.name()  # qualified by the table or its alias
        return Node("column", (name,))

    def skip(self) -> int:
        self.at += 1
        return 0

    def case(self) -> Node:
        """``CASE [operand] WHEN ... THEN ... [ELSE ...] END`` as conditions, values and the default."""
        operand = None if self.peek("when") else self.expression()
        parts: list[Node] = []
        while self.take("when"):
            test = self.expression()
            self.need("then")
            parts += [test if operand is None else Node("=", (operand, test)), self.expression()]
        if not parts:
            raise SelectError("expected WHEN")
        default = self.expression() if self.take("else") else Node("literal", (None,))
        self.need("end")
        return Node("case", (*parts, default))


def parse(sql: str) -> Query:
    """Parse the first statement of ``sql``."""
    return _Parser(sql).query()


#: Types that CAST knows.
CASTS = {
    "int": "bigint", "integer": "bigint", "bigint": "bigint", "float": "double", "double": "double", "decimal": "double", "numeric": "double",
    "string": "string", "varchar": "string", "char": "string", "bool": "boolean", "boolean": "boolean", "timestamp": "timestamp", "date": "date",
}

#: Functions of the select language: least and most number of arguments, and how they are built.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "upper": (1, 1, F.upper), "lower": (1, 1, F.lower), "trim": (1, 1, F.trim), "char_length": (1, 1, F.char_length), "character_length": (1, 1, F.char_length),
    "substring": (2, 3, lambda s, at, n=None: F.substring(s, at, F.length(s) if n is None else n)), "coalesce": (1, 99, F.coalesce), "nullif": (2, 2, F.nullif),
    "abs": (1, 1, F.abs), "floor": (1, 1, F.floor), "ceil": (1, 1, F.ceil), "round": (1, 1, F.round),
}


# Standard mode ------------------------------------------------------------------


def _cast(value: Column, kind: str) -> Column:
    """A cast that is null where it fails; floating numbers become the nearest whole one, halves the even one."""
    if kind != "bigint":
        return value.try_cast(kind)
    floating = F.typeof(value).isin("double", "float")  # constant once the type is known
    return F.when(floating, F.rint(value.try_cast("double")).try_cast(kind)).otherwise(value.try_cast(kind))


def _standard(node: Node, names: set[str]) -> Column:
    build = lambda n: _standard(n, names)
    op, args = node.op, node.args
    if op == "column":
        if args[0] not in names:
            raise SelectError(f"no column {args[0]!r}")
        return F.col(f"`{args[0]}`")
    if op == "literal":
        return F.lit(args[0])
    if op == "unsupported":
        raise SelectError("SIMILAR TO, EXISTS and subqueries are not part of the language")
    if op == "case":
        out = F.when(build(args[0]), build(args[1]))
        for test, value in zip(args[2:-1:2], args[3:-1:2], strict=True):
            out = out.when(build(test), build(value))
        return out.otherwise(build(args[-1]))
    if op == "cast":
        if args[1] not in CASTS:
            raise SelectError(f"no type {args[1]!r}")
        return _cast(build(args[0]), CASTS[args[1]])
    if op == "call":
        least, most, make = FUNCTIONS.get(args[0], (1, 0, F.coalesce))
        if not least <= len(args) - 1 <= most:
            raise SelectError(f"no function {args[0]!r} of {len(args) - 1} arguments")
        return make(*map(build, args[1:]))
    if op == "ilike":
        return F.ilike(build(args[0]), build(args[1]))
    if op in ("in", "not in"):
        found = build(args[0]).isin(*map(build, args[1:]))
        return ~found if op == "not in" else found
    if op in ("between", "not between"):
        inside = build(args[0]).between(build(args[1]), build(args[2]))
        return ~inside if op == "not between" else inside
    if op in ("like", "not like"):
        escape = F.lit("\\") if args[2] is None else build(args[2])
        like = F.like(build(args[0]), build(args[1]), escape)
        return ~like if op == "not like" else like
    a = build(args[0])
    if op in ("not", "negative", "is null", "is not null"):
        return {"not": lambda: ~a, "negative": lambda: -a, "is null": a.isNull, "is not null": a.isNotNull}[op]()
    b = build(args[1])
    return {
        "and": lambda: a & b, "or": lambda: a | b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b,
        ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b,
        "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b), "||": lambda: F.concat(a, b),
    }[op]()


# Compat mode --------------------------------------------------------------------

@dataclass
class Cell:
    """A dynamically typed value as one column for each type it may have."""

    num: Column = field(default_factory=lambda: F.lit(None).cast("double"))
    text: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    flag: Column = field(default_factory=lambda: F.lit(None).cast("boolean"))
    #: Neither null nor missing, but of a type without operators (array, object).
    other: Column = field(default_factory=lambda: F.lit(False))
    missing: Column = field(default_factory=lambda: F.lit(False))

    @property
    def null(self) -> Column:
        return self.num.isNull() & self.text.isNull() & self.flag.isNull() & ~self.other


def _cell(column: Column, kind: T.DataType) -> Cell:
    if isinstance(kind, T.NumericType):
        return Cell(num=column.cast("double"))
    if isinstance(kind, T.BooleanType):
        return Cell(flag=column)
    if isinstance(kind, T.StringType):
        return Cell(text=column)
    if isinstance(kind, T.VariantType):
        name = F.coalesce(F.schema_of_variant(column), F.lit("VOID"))
        number = name.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
        return Cell(
            num=F.when(number, F.try_variant_get(column, "$", "double")),
            text=F.when(name == "STRING", F.try_variant_get(column, "$", "string")),
            flag=F.when(name == "BOOLEAN", F.try_variant_get(column, "$", "boolean")),
            other=name.rlike("^(ARRAY|OBJECT)"),
        )
    return Cell(other=column.isNotNull())


def _either(a: Cell, b: Cell) -> Column:
    return a.missing | b.missing


def _equal(a: Cell, b: Cell) -> Column:
    return F.coalesce(a.num == b.num, F.lit(False)) | F.coalesce(a.text == b.text, F.lit(False)) | F.coalesce(a.flag == b.flag, F.lit(False)) | (a.null & b.null)


def _order(a: Cell, b: Cell) -> Column:
    """-1, 0 or 1, or null where the two cannot be ordered."""
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
    return F.coalesce(sign(a.num, b.num), sign(a.text, b.text))


def _compat(node: Node, types: dict[str, T.DataType]) -> Cell:
    build = lambda n: _compat(n, types)
    op, args = node.op, node.args
    if op == "column":
        return _cell(F.col(f"`{args[0]}`"), types[args[0]]) if args[0] in types else Cell(missing=F.lit(True))
    if op == "literal":
        v = args[0]
        if v is None:
            return Cell()
        return Cell(flag=F.lit(v)) if isinstance(v, bool) else Cell(text=F.lit(v)) if isinstance(v, str) else Cell(num=F.lit(float(v)))
    if op in ("not", "negative", "case", "cast", "call", "ilike", "unsupported"):
        return Cell(missing=F.lit(True))
    if op in ("is null", "is not null"):
        a = build(args[0])
        absent = a.missing | a.null
        return Cell(flag=absent if op == "is null" else ~absent)
    if op in ("in", "not in"):
        a, items = build(args[0]), [build(x) for x in args[1:]]
        found = reduce(lambda x, y: x | y, [_equal(a, i) & ~i.missing for i in items])
        return Cell(flag=~found if op == "not in" else found, missing=a.missing)
    if op in ("between", "not between"):
        a, low, high = map(build, args)
        inside = F.coalesce((_order(a, low) >= 0) & (_order(a, high) <= 0), F.lit(False))
        return Cell(flag=~inside if op == "not between" else inside, missing=a.missing | low.missing | high.missing)
    if op in ("like", "not like"):
        a, p = build(args[0]), build(args[1])
        pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(p.text, "%", ".*"), "_", "."), F.lit("$"))
        match = F.rlike(a.text, pattern)
        return Cell(flag=F.coalesce(~match if op == "not like" else match, F.lit(False)), missing=_either(a, p))
    a, b = build(args[0]), build(args[1])
    missing = _either(a, b)
    if op in ("=", "<>"):
        return Cell(flag=_equal(a, b) if op == "=" else ~_equal(a, b), missing=missing)
    if op in ("<", "<=", ">", ">="):
        o = _order(a, b)
        flag = {"<": o < 0, "<=": o <= 0, ">": o > 0, ">=": o >= 0}[op]
        return Cell(flag=flag, missing=missing | o.isNull())
    if op in ("and", "or"):
        flag = a.flag & b.flag if op == "and" else a.flag | b.flag
        return Cell(flag=flag, missing=missing | a.flag.isNull() | b.flag.isNull())
    if op == "||":
        return Cell(text=F.concat(a.text, b.text), missing=missing | a.text.isNull() | b.text.isNull())
    value = {"+": lambda: a.num + b.num, "-": lambda: a.num - b.num, "*": lambda: a.num * b.num, "/": lambda: F.try_divide(a.num, b.num), "%": lambda: F.try_mod(a.num, b.num)}[op]()
    return Cell(num=value, missing=missing | value.isNull())


def predicate(where: Node, schema: T.StructType, mode: str = "standard") -> Column:
    """The filter of a statement: true where a row is kept."""
    if mode == "standard":
        return _standard(where, set(schema.names))
    cell = _compat(where, {f.name: f.dataType for f in schema})
    return ~cell.missing & F.coalesce(cell.flag, F.lit(False))


def select(df: DataFrame, sql: str, mode: str = "standard") -> DataFrame:
    """Run a statement over ``df``.

    In ``compat`` mode a projected name that the table does not have is left out, an
    alias renames nothing that exists (so the column is left out too), and other
    expressions are left out; ``standard`` mode evaluates them or raises.
    """
    if mode not in ("standard", "compat"):
        raise ValueError(mode)
    query = parse(sql)
    out = df if query.where is None else df.where(predicate(query.where, df.schema, mode))
    if query.limit is not None:
        out = out.limit(query.limit)
    if query.columns is None:
        return out
    if mode == "standard":
        return out.select(*[_standard(node, set(df.columns)).alias(name) for node, name in query.columns])
    return out.select(*[F.col(f"`{name}`") for node, name in query.columns if node.op == "column" and name in df.columns])


# Requests -----------------------------------------------------------------------


@dataclass
class Request:
    """A statement with the formats of its input and output, and the bytes of the input to scan."""

    expression: str
    input_format: str = "JSON"
    input_options: dict[str, str] = field(default_factory=dict)
    compression: str = "NONE"
    output_format: str = "JSON"
    output_options: dict[str, str] = field(default_factory=dict)
    start: int | None = None
    end: int | None = None


def _tree(element: ElementTree.Element) -> dict | str:
    children = list(element)
    return {c.tag.rsplit("}", 1)[-1]: _tree(c) for c in children} if children else (element.text or "").strip()


def parse_request(body: bytes | str) -> Request:
    """A request from its body: JSON is tried first, then XML."""
    try:
        text = body if isinstance(body, str) else body.decode("utf-8")
    except UnicodeDecodeError as e:
        raise SelectError(f"not UTF-8: {e}") from e
    try:
        data = json.loads(text)
    except ValueError:
        if "<!DOCTYPE" in text or "<!ENTITY" in text:
            raise SelectError("document types are not accepted") from None
        try:
            data = _tree(ElementTree.fromstring(text))
        except ElementTree.ParseError as e:
            raise SelectError(f"neither JSON nor XML: {e}") from e
    if not isinstance(data, dict) or not data.get("Expression"):
        raise SelectError("a request needs an Expression")
    if str(data.get("ExpressionType", "")).upper() != "SQL":
        raise SelectError("ExpressionType must be SQL")
    out = Request(data["Expression"])
    source, sink, span = (data.get(k) or {} for k in ("InputSerialization", "OutputSerialization", "ScanRange"))
    if not isinstance(source, dict) or not isinstance(sink, dict):
        raise SelectError("serializations must be objects")
    known = [k for k in ("CSV", "JSON", "Parquet") if k in source]
    if len(known) != 1:
        raise SelectError("InputSerialization needs one of CSV, JSON and Parquet")
    out.input_format, out.compression = known[0], str(source.get("CompressionType") or "NONE").upper()
    if out.compression not in ("NONE", "GZIP", "BZIP2"):
        raise SelectError(f"no compression {out.compression!r}")
    options = source[known[0]]
    out.input_options = {k: str(v) for k, v in options.items()} if isinstance(options, dict) else {}
    out.output_format = "CSV" if "CSV" in sink else "JSON"
    options = sink.get(out.output_format)
    out.output_options = {k: str(v) for k, v in options.items()} if isinstance(options, dict) else {}
    if isinstance(span, dict):
        out.start, out.end = (int(span[k]) if span.get(k) not in (None, "") else None for k in ("Start", "End"))
    return out


def run_request(spark: SparkSession, body: bytes | str, path: str, mode: str = "compat") -> DataFrame:
    """Answer a request over the objects at ``path``: one column ``value``, a record in each row.

    Compressed input is told by its file ending, as everywhere in Spark; the request's
    compression type must not contradict it.
    """
    from lakeglass.sources import readers, sinks

    r = parse_request(body)
    ending = {"GZIP": ".gz", "BZIP2": ".bz2"}.get(r.compression)
    if ending and not path.rstrip("/").endswith((ending, "*")):
        raise SelectError(f"{r.compression} input ends in {ending}")
    if r.input_format == "Parquet":
        df = readers.read_parquet(spark, path)
    elif r.input_format == "CSV":
        df = readers.read_csv(spark, path, header=r.input_options.get("FileHeaderInfo", "NONE").upper(), delimiter=r.input_options.get("FieldDelimiter", ","), typed=mode == "compat")
    else:
        df = readers.read_json(spark, path, document=r.input_options.get("Type", "LINES").upper() == "DOCUMENT")
    out = select(df, r.expression, mode)
    return sinks.csv_lines(out, delimiter=r.output_options.get("FieldDelimiter", ",")) if r.output_format == "CSV" else sinks.json_lines(out)
