"""Object description labels: tokens and statements as rows; what is wrong is a row too, never an exception in a task."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed limits: bytes of a header, tokens, depth of sequences, items of one, depth of blocks.
HEADER, TOKENS, DEPTH, ITEMS, BLOCKS = 1 << 20, 65_536, 16, 4096, 32
LEX = re.compile(r"""(?P<skip>[\s;]+|/\*.*?\*/|&[ \t]*\r?\n)|"(?P<text>[^"]*)"|'(?P<symbol>[^'\r\n]*)'|(?P<mark>[=(),<>])|(?P<word>(?:(?!/\*)[^\s=(),<>;"'&])+)""", re.S)
LONGEST, UNITS = 24, 16
INTEGER, RADIX, REAL = re.compile(r"[+-]?[0-9]+"), re.compile(r"([0-9]{1,2})#([+-]?)([0-9A-Fa-f]+)#"), re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
NAME = re.compile(r"[A-Za-z][\w:./+-]*|[0-9]{4}-[0-9TtZz:.+-]+", re.A)
SENTINELS = {"NULL", "UNK", "N/A"}


class OdlError(ValueError):
    pass


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, end) of each token; kinds are STRING, WORD and the marks themselves."""
    at = n = 0
    for m in LEX.finditer(text):
        if m.start() != at:
            break
        at, kind = m.end(), m.lastgroup
        if kind == "skip":
            continue
        n += 1
        if n > TOKENS:
            raise OdlError("too many tokens")
        body = m[kind]
        if kind == "word":
            yield "WORD", body, at
        elif kind == "mark":
            yield body, body, at
        else:
            if "\\" in body or not body.isascii():
                raise OdlError("escape or encoding in a string")
            yield "STRING", body.upper() if kind == "symbol" else body, at
    if at != len(text):
        raise OdlError(f"no token at {at}")


def scalar(word: str) -> tuple[str, str]:
    """(type, canonical text) of a bare word."""
    if word.upper() in SENTINELS:
        return "null", word.upper()
    if INTEGER.fullmatch(word):
        if len(word) > LONGEST:
            raise OdlError("an integer too long")
        return "integer", str(int(word))
    if m := RADIX.fullmatch(word):
        base, sign, digits = int(m[1]), m[2], m[3]
        if not 2 <= base <= 16 or len(sign + digits) > LONGEST:
            raise OdlError("radix")
        try:
            return "integer", str(int(sign + digits, base))
        except ValueError:
            raise OdlError("digits beyond the radix") from None
    if REAL.fullmatch(word):
        v = float(word)
        if v in (float("inf"), float("-inf")):
            raise OdlError("a number that isn't finite")
        return "real", repr(v)
    if not NAME.fullmatch(word):
        raise OdlError("a word of no known form")
    return "name", word


def statements(data: bytes) -> tuple[list[tuple], int]:
    """((path, key, ordinal, item, type, text, unit, kinds, block, form) of every value, byte after END). A stack of open blocks, no recursion.

    kinds are those of the open blocks, block is the number of the innermost one (0 outside of all), form tells a radix.
    """
    stream = list(tokens(data[:HEADER].decode("latin-1")))
    rows: list[tuple] = []
    path: list[tuple[str, str, int]] = []
    i, ordinal, blocks = 0, 0, 0

    def take(kind: str) -> str:
        nonlocal i
        if i >= len(stream) or stream[i][0] != kind:
            raise OdlError(f"{kind} expected")
        i += 1
        return stream[i - 1][1]

    while i < len(stream):
        kind, word, end = stream[i]
        if kind != "WORD":
            raise OdlError("a statement begins with a word")
        i += 1
        key = word.upper()
        if key == "END":
            if path:
                raise OdlError("END within a block")
            return rows, end
        if key.startswith("^") and key[1:] == "STRUCTURE":
            raise OdlError("includes are not read")
        if key in ("END_OBJECT", "END_GROUP"):
            if i < len(stream) and stream[i][0] == "=":
                take("=")
                if take("WORD").upper() != (path[-1][1] if path else None):
                    raise OdlError("a block ends by another name")
            if not path or path.pop()[0] != key[4:]:
                raise OdlError("a block ends that wasn't begun")
            continue
        take("=")
        if key in ("OBJECT", "GROUP"):
            blocks += 1
            path.append((key, take("WORD").upper(), blocks))
            if len(path) > BLOCKS:
                raise OdlError("blocks too deep")
            continue
        ordinal += 1
        depth = item = 0
        while True:
            if i >= len(stream):
                raise OdlError("a value is missing")
            kind, text, _ = stream[i]
            if kind == "(":
                depth += 1
                if depth > DEPTH:
                    raise OdlError("sequences too deep")
                i += 1
                continue
            if kind not in ("WORD", "STRING"):
                raise OdlError("a value expected")
            i += 1
            what, value = ("string", text) if kind == "STRING" else scalar(text)
            unit = None
            if i < len(stream) and stream[i][0] == "<":
                take("<")
                unit = take("WORD")
                while i < len(stream) and stream[i][0] == "WORD":
                    unit += " " + take("WORD")
                take(">")
                if what not in ("integer", "real") or unit.count(" ") >= UNITS:
                    raise OdlError("units")
                unit = unit.upper()
            item += 1
            if item > ITEMS:
                raise OdlError("too many items")
            form = "radix" if kind == "WORD" and "#" in text else None
            rows.append(("/".join(n for _, n, _ in path), key, ordinal, item, what, value, unit, "/".join(k for k, _, _ in path), path[-1][2] if path else 0, form))
            while depth and i < len(stream) and stream[i][0] == ")":
                i, depth = i + 1, depth - 1
            if not depth:
                break
            take(",")
    raise OdlError("END is missing")


def is_label(text: str) -> bool:
    """Whether the first tokens name the third version of the standard."""
    try:
        got = []
        for t in tokens(text[:4096]):
            got.append(t[1].upper() if t[0] != "STRING" else t[1])
            if got[-3:-1] == ["PDS_VERSION_ID", "="]:
                return got[-1].upper() == "PDS3"
    except OdlError:
        pass
    return False


VALUES = ("path", "key", "ordinal", "item", "type", "value", "unit")
ROWS = "path string, key string, ordinal int, item int, type string, value string, unit string, kinds string, block int, form string, last bigint, violation string"


def _exploded(t: DataFrame, id_: str, column: str, rows, schema: str) -> DataFrame:
    """For each row the tuples that rows() makes of its column, in Arrow batches, with the row's id in front."""
    kinds = schema.split(", ")
    arrow = pa.schema([pa.field(x.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[x.split()[1]]) for x in kinds])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):  # labels of up to 1 MiB: a few at a time
                part = b.slice(i, 512)
                made = [rows(x) for x in part.column(1).to_pylist()]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made])))
                flat = [r for m in made for r in m]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*flat) if flat else [()] * len(arrow), arrow)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=[id_, *arrow.names])

    return t.select(id_, column).mapInArrow(run, f"`{id_}` {t.schema[id_].dataType.simpleString()}, {schema}")


def parsed(labels: DataFrame, id_: str = "id", content: str = "content") -> DataFrame:
    """A row for each value of each label (binary), or one with a violation; last is the byte after the label's END."""

    def rows(data):
        try:
            values, last = statements(data or b"")
            return [(*r, last, None) for r in values]
        except OdlError as e:
            return [(None,) * 11 + (str(e),)]

    return _exploded(labels, id_, content, rows, ROWS)


def sniffed(texts: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """id and is_label of each text."""

    def run(batches):
        for b in batches:
            got = pa.array([is_label(x or "") for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=[id_, "is_label"])

    # the first tokens are within 4096 characters: no more leaves the JVM
    t = texts.select(id_, F.substring(text, 1, 4096).alias(text))
    return t.mapInArrow(run, f"`{id_}` {t.schema[id_].dataType.simpleString()}, is_label boolean")


def tokenised(labels: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """A row for each token: ord, kind, text, end; the last one of a text that can't be read is a violation."""

    def rows(t):
        out = []
        try:
            out.extend(tokens(t or ""))
        except OdlError as e:
            out.append(("VIOLATION", str(e), -1))
        return [(i, *x) for i, x in enumerate(out)]

    return _exploded(labels, id_, text, rows, "ord bigint, kind string, text string, end int")


def repeated_keys(values: DataFrame, id_: str = "id") -> DataFrame:
    """Keys that a block repeats: reading one of them is ambiguous."""
    n = values.where("violation is null").groupBy(id_, "path", "key").agg(F.countDistinct("ordinal").alias("n"))
    return n.where("n > 1")
