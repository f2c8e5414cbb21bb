"""A subset of jq over JSON columns, compiled to VARIANT expressions: no UDF.

Supported: ``.``, ``.a``, ``."a"``, ``.[n]``, ``.[a:b]``, ``.[]``, ``|``, ``,``, ``length``, ``keys``, ``type``, ``not``, ``map(f)``,
``select(f)``, ``has("a")``, comparisons, ``and``/``or``, literals, ``{a: f, b}`` and ``[f]``. Anything else raises
``SyntaxError``. A program gives rows (key, ord, value): the results in order, as JSON text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|(-?[0-9]+(?:\.[0-9]+)?)|(==|!=|<=|>=|<|>)|([A-Za-z_][A-Za-z0-9_]*)|(\.\.|.))', re.S)


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple = ()


class Parser:
    def __init__(self, text: str):
        self.tokens = [next(x for x in m if x) for m in _TOKENS.findall(text.strip())]
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if not token or expected is not None and token != expected:
            raise SyntaxError(f"expected {expected or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def program(self) -> Op:
        out = self.pipe()
        if self.peek():
            raise SyntaxError(f"unexpected {self.peek()}")
        return out

    def pipe(self) -> Op:
        out = self.comma()
        while self.peek() == "|":
            self.take()
            out = Op("pipe", (out, self.comma()))
        return out

    def comma(self) -> Op:
        parts = [self.logic()]
        while self.peek() == ",":
            self.take()
            parts.append(self.logic())
        return parts[0] if len(parts) == 1 else Op("comma", tuple(parts))

    def logic(self) -> Op:
        out = self.comparison()
        while self.peek() in ("and", "or"):
            out = Op(self.take(), (out, self.comparison()))
        return out

    def comparison(self) -> Op:
        out = self.postfix()
        if self.peek() in ("==", "!=", "<", ">", "<=", ">="):
            out = Op("compare", (self.take(), out, self.postfix()))
        return out

    def postfix(self) -> Op:
        out = self.term()
        while self.peek() in (".", "["):
            if self.peek() == ".":
                if self.peek(1) == "[":
                    self.take()
                    continue
                self.take()
                out = Op("pipe", (out, self.field()))
            else:
                out = Op("pipe", (out, self.bracket()))
        return out

    def field(self) -> Op:
        name = self.take()
        if name.startswith('"'):
            return Op("field", (name[1:-1],))
        if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
            raise SyntaxError(f"no field name: {name}")
        return Op("field", (name,))

    def bracket(self) -> Op:
        self.take("[")
        if self.peek() == "]":
            self.take()
            return Op("each")
        if self.peek().startswith('"'):
            name = self.take()[1:-1]
            self.take("]")
            return Op("field", (name,))
        start = int(self.take()) if re.fullmatch("-?[0-9]+", self.peek()) else None
        if self.peek() == ":":
            self.take()
            stop = int(self.take()) if re.fullmatch("-?[0-9]+", self.peek()) else None
            self.take("]")
            return Op("slice", (start, stop))
        self.take("]")
        if start is None:
            raise SyntaxError("empty index")
        return Op("index", (start,))

    def term(self) -> Op:
        token = self.peek()
        if token == ".":
            self.take()
            if self.peek() == "[":
                return self.bracket()
            if re.fullmatch('[A-Za-z_][A-Za-z0-9_]*|".*"', self.peek()) and self.peek() not in ("and", "or"):
                return self.field()
            return Op("self")
        if token == "(":
            self.take()
            out = self.pipe()
            self.take(")")
            return out
        if token == "{":
            return self.object()
        if token == "[":
            self.take()
            out = self.pipe()
            self.take("]")
            return Op("collect", (out,))
        if token.startswith('"'):
            return Op("literal", (self.take()[1:-1],))
        if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", token):
            return Op("literal", (float(self.take()),))
        if token in ("true", "false", "null"):
            return Op("literal", ({"true": True, "false": False, "null": None}[self.take()],))
        if token in ("length", "keys", "type", "not"):
            return Op(self.take())
        if token in ("map", "select", "has"):
            self.take()
            self.take("(")
            inner = self.pipe()
            self.take(")")
            return Op(token, (inner,))
        raise SyntaxError(f"unsupported: {token or 'an empty program'}")

    def object(self) -> Op:
        self.take("{")
        pairs = []
        while self.peek() != "}":
            name = self.take()
            name = name[1:-1] if name.startswith('"') else name
            if self.peek() == ":":
                self.take()
                pairs.append((name, self.logic()))
            else:
                pairs.append((name, Op("field", (name,))))
            if self.peek() == ",":
                self.take()
        self.take("}")
        return Op("object", tuple(pairs))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _entries(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _variant(json: Column) -> Column:
    return F.try_parse_json(json)


def _json(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))


def one(op: Op, v: Column) -> Column:
    """The single result of a program without ``each``, ``select`` or ``,`` as a VARIANT; null is JSON null."""
    match op.name:
        case "self":
            return v
        case "field":
            return _get(v, f"$['{op.args[0]}']")
        case "index":
            (k,) = op.args
            items = _elements(v)
            return F.get(items, F.lit(k) if k >= 0 else F.size(items) + k)
        case "slice":
            start, stop = op.args
            items = _elements(v)
            n = F.size(items)
            place = lambda x: F.greatest(F.lit(0), n + x) if x < 0 else F.least(F.lit(x), n)
            low, high = place(start or 0), place(stop) if stop is not None else n
            part = F.slice(items, low + 1, F.greatest(high - low, F.lit(0)))
            return _variant(F.concat(F.lit("["), F.array_join(F.transform(part, _json), ","), F.lit("]")))
        case "pipe":
            return one(op.args[1], one(op.args[0], v))
        case "literal":
            value = op.args[0]
            if value is None:
                return _variant(F.lit("null"))
            if isinstance(value, bool):
                return _variant(F.lit(str(value).lower()))
            if isinstance(value, float):
                return _variant(F.lit(repr(int(value)) if value == int(value) else repr(value)))
            return _variant(F.lit('"' + value + '"'))
        case "length":
            kind = _kind(v)
            text = F.try_variant_get(v, "$", "string")
            number = F.abs(F.try_variant_get(v, "$", "double"))
            n = F.when(kind == "array", F.size(_elements(v))).when(kind == "object", F.size(F.map_keys(_entries(v)))).when(kind == "string", F.length(text)).otherwise(F.lit(0))
            return _variant(F.when(kind == "number", F.regexp_replace(number.cast("string"), r"\.0$", "")).otherwise(n.cast("string")))
        case "keys":
            names = F.array_sort(F.map_keys(_entries(v)))
            numbers = F.sequence(F.lit(0), F.size(_elements(v)) - 1)
            array = F.when(F.size(_elements(v)) > 0, F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ","), F.lit("]"))).otherwise("[]")
            return _variant(F.when(_kind(v) == "array", array).otherwise(F.to_json(names)))
        case "type":
            return _variant(F.concat(F.lit('"'), _kind(v), F.lit('"')))
        case "not":
            return _variant(F.when(truth(v), "false").otherwise("true"))
        case "has":
            return _variant(F.when(F.coalesce(F.array_contains(F.map_keys(_entries(v)), op.args[0].args[0]), F.lit(False)), "true").otherwise("false"))
        case "and" | "or":
            a, b = (truth(one(x, v)) for x in op.args)
            return _variant(((a & b) if op.name == "and" else (a | b)).cast("string"))
        case "compare":
            return _variant(compare(op.args[0], one(op.args[1], v), one(op.args[2], v)).cast("string"))
        case "object":
            parts = [F.concat(F.lit(f'"{name}":'), _json(one(x, v))) for name, x in op.args]
            return _variant(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
        case "map":
            return _variant(F.concat(F.lit("["), F.array_join(F.transform(F.flatten(F.transform(_elements(v), lambda x: many(op.args[0], x))), _json), ","), F.lit("]")))
        case "collect":
            return _variant(F.concat(F.lit("["), F.array_join(F.transform(many(op.args[0], v), _json), ","), F.lit("]")))
    raise SyntaxError(f"{op.name} gives several results here")


def many(op: Op, v: Column) -> Column:
    """All results as an array of VARIANT."""
    match op.name:
        case "each":
            return F.coalesce(_elements(v), F.map_values(_entries(v)), F.array().cast("array<variant>"))
        case "comma":
            return F.concat(*(many(x, v) for x in op.args))
        case "select":
            return F.when(truth(one(op.args[0], v)), F.array(v)).otherwise(F.array().cast("array<variant>"))
        case "pipe":
            return F.flatten(F.transform(many(op.args[0], v), lambda x: many(op.args[1], x)))
    return F.array(one(op, v))


def _kind(v: Column) -> Column:
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (name == "VOID"), "null").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").otherwise("number")
    )


def truth(v: Column) -> Column:
    """All but null and false is true."""
    return ~((_kind(v) == "null") | F.coalesce(F.try_variant_get(v, "$", "boolean") == F.lit(False), F.lit(False)) & (_kind(v) == "boolean"))


def compare(sign: str, a: Column, b: Column) -> Column:
    """Numbers by value, others as JSON text; different types by their rank."""
    numbers = (_kind(a) == "number") & (_kind(b) == "number")
    x, y = F.try_variant_get(a, "$", "double"), F.try_variant_get(b, "$", "double")
    s, t = _json(a), _json(b)
    by = {"==": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[sign]
    return F.when(numbers, by(x, y)).otherwise(by(s, t))


def jq(rows: DataFrame, program: str, key: str, json: str) -> DataFrame:
    """(key, ord, value) of a program over a column of JSON text; texts that aren't JSON give no rows."""
    op = Parser(program).program()
    parsed = rows.select(F.col(key), F.try_parse_json(json).alias("_v")).where("_v is not null")
    return parsed.select(key, F.posexplode(many(op, F.col("_v"))).alias("ord", "_r")).select(key, "ord", _json(F.col("_r")).alias("value"))
