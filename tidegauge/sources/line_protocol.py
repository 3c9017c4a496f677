"""Line protocol: text lines to points, and points back to lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.literals import PRECISIONS, QueryError

SCHEMA = "measurement string, tags map<string,string>, fields map<string,struct<kind:string,f:double,i:bigint,b:boolean,s:string>>, time_ns bigint, line bigint, error string"
_INT = re.compile(r"[+-]?\d+i")
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_TRUE, _FALSE = frozenset(("t", "true")), frozenset(("f", "false"))


def _split(text: str, stops: str) -> list[str]:
    """Parts between unescaped, unquoted stop characters."""
    out, start, at, quoted = [], 0, 0, False
    while at < len(text):
        x = text[at]
        if x == "\\":
            at += 2
            continue
        if x == '"' and stops != ",=":
            quoted = not quoted
        elif x in stops and not quoted:
            out.append(text[start:at])
            start = at + 1
        at += 1
    return [*out, text[start:]]


def _plain(text: str) -> str:
    return re.sub(r"\\([,= \\])", r"\1", text) if "\\" in text else text


def _first(text: str, stop: str) -> int:
    """Place of the first unescaped ``stop`` outside quotes."""
    at, quoted = 0, False
    while at < len(text):
        if text[at] == "\\":
            at += 1
        elif text[at] == '"':
            quoted = not quoted
        elif text[at] == stop and not quoted:
            return at
        at += 1
    return -1


def field_value(text: str) -> dict:
    """A typed field value from its literal."""
    empty = {"kind": None, "f": None, "i": None, "b": None, "s": None}
    if text.startswith('"'):
        if len(text) < 2 or not text.endswith('"'):
            raise ValueError(f"unclosed string {text}")
        return empty | {"kind": "string", "s": re.sub(r'\\(["\\])', r"\1", text[1:-1])}
    if text.lower() in _TRUE or text.lower() in _FALSE:
        return empty | {"kind": "boolean", "b": text.lower() in _TRUE}
    if _INT.fullmatch(text):
        value = int(text[:-1])
        if not -(1 << 63) <= value < 1 << 63:
            raise ValueError(f"integer out of range {text}")
        return empty | {"kind": "integer", "i": value}
    if _FLOAT.fullmatch(text):
        return empty | {"kind": "float", "f": float(text)}
    raise ValueError(f"not a field value: {text}")


def parse_line(line: str, multiplier: int = 1, now: int | None = None) -> tuple[str, dict, dict, int] | None:
    """(measurement, tags, fields, time in ns); None for blank lines and comments."""
    line = line.rstrip("\r\n").strip(" ")
    if not line or line.startswith("#"):
        return None
    gap = _space(line)
    if gap < 0:
        raise ValueError("no fields")
    head, rest = line[:gap], line[gap + 1 :].lstrip(" ")
    name, *pairs = _split_head(head)
    if not name:
        raise ValueError("no measurement")
    tags = {}
    for pair in pairs:
        k = _first_plain(pair, "=")
        if k <= 0:
            raise ValueError(f"not a tag: {pair}")
        if pair[k + 1 :]:
            tags[_plain(pair[:k])] = _plain(pair[k + 1 :])
    end = _first(rest, " ")
    body, stamp = (rest, "") if end < 0 else (rest[:end], rest[end + 1 :].strip())
    fields = {}
    for pair in _split(body, ","):
        k = _first_plain(pair, "=")
        if k <= 0:
            raise ValueError(f"not a field: {pair}")
        fields[_plain(pair[:k])] = field_value(pair[k + 1 :])
    if stamp:
        time_ns = int(stamp) * multiplier
        if not -(1 << 63) <= time_ns < 1 << 63:
            raise ValueError("time out of range")
    elif now is None:
        raise ValueError("no time")
    else:
        time_ns = now
    if not tags and fields.get("tag", {}).get("kind") == "string":
        tags["tag"] = fields.pop("tag")["s"]
        if not fields:
            raise ValueError("no fields")
    return _plain(name), tags, fields, time_ns


def _space(text: str) -> int:
    at = 0
    while at < len(text):
        if text[at] == "\\":
            at += 1
        elif text[at] == " ":
            return at
        at += 1
    return -1


def _split_head(text: str) -> list[str]:
    out, start, at = [], 0, 0
    while at < len(text):
        if text[at] == "\\":
            at += 1
        elif text[at] == ",":
            out.append(text[start:at])
            start = at + 1
        at += 1
    return [*out, text[start:]]


def _first_plain(text: str, stop: str) -> int:
    at = 0
    while at < len(text):
        if text[at] == "\\":
            at += 1
        elif text[at] == stop:
            return at
        at += 1
    return -1


# Lines that need no look at single characters: names without escapes, quotes and equals
# signs, literals that are valid and in range.
_NAME = r"[^,\s\\=\"]+"
_TEXT = r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
_FIELD = rf"{_NAME}=(?:{_TEXT}|[+-]?\d{{1,18}}i|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:t|true|f|false))"
_STAMP = r" +(-?\d+)$"
#: Longer lines are read in Python: a pattern may need stack for every escaped character.
PLAIN_CHARS = 4000


def _plain_points(lines: DataFrame, multiplier: int, now_ns: int | None) -> DataFrame:
    """``lines`` with ``text`` (the trimmed line), ``plain`` and, for plain lines, the
    columns of a point. All in Spark's own functions."""
    text = F.expr("trim(BOTH ' ' FROM trim(TRAILING '\\r\\n' FROM value))")
    digits = 20 - len(str(multiplier))
    shape = rf"^{_NAME}(?:,{_NAME}={_NAME})* +{_FIELD}(?:,{_FIELD})*(?: +-?\d{{1,{digits}}}){'' if now_ns is None else '?'}$"
    out = lines.withColumn("text", text).withColumn("head", F.substring_index("text", " ", 1))
    out = out.withColumn("stamp", F.regexp_extract("text", _STAMP, 1))
    out = out.withColumn("at", F.when(F.col("stamp") != "", F.try_multiply(F.col("stamp").try_cast("bigint"), F.lit(multiplier).cast("bigint"))).otherwise(F.lit(now_ns).cast("bigint")))
    out = out.withColumn("pairs", F.regexp_extract_all("text", F.lit(rf"(?<=[ ,]){_FIELD}(?=[ ,]|$)"), F.lit(0)))
    out = out.withColumn("tags_", F.transform(F.slice(F.split("head", ","), 2, 1 << 30), lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.substring_index(t, "=", -1).alias("value"))))
    out = out.withColumn("names", F.transform("pairs", lambda x: F.substring_index(x, "=", 1)))
    alone = (F.size(F.array_distinct("names")) == F.size("names")) & (F.size(F.array_distinct("tags_.key")) == F.size("tags_"))
    named = (F.size("tags_") == 0) & F.array_contains("names", "tag")  # a field that becomes a tag
    plain = (F.length("text") <= PLAIN_CHARS) & F.col("text").rlike(shape) & alone & ~named & F.col("at").isNotNull()
    out = out.withColumn("plain", F.coalesce(plain, F.lit(False)))

    def field(x: Column) -> Column:
        raw = F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x))
        none = {k: F.lit(None).cast(t) for k, t in (("kind", "string"), ("f", "double"), ("i", "bigint"), ("b", "boolean"), ("s", "string"))}

        def value(kind: str, at: str, v: Column) -> Column:
            return F.struct(*(y.alias(k) for k, y in (none | {"kind": F.lit(kind), at: v}).items()))

        inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
        typed = (
            F.when(F.startswith(raw, F.lit('"')), value("string", "s", F.regexp_replace(inner, r'\\(["\\])', "$1"))).when(F.endswith(raw, F.lit("i")), value("integer", "i", F.substring(raw, F.lit(1), F.length(raw) - 1).try_cast("bigint")))
            .when(F.lower(raw).isin("t", "true", "f", "false"), value("boolean", "b", F.startswith(F.lower(raw), F.lit("t")))).otherwise(value("float", "f", raw.try_cast("double")))
        )
        return F.struct(F.substring_index(x, "=", 1).alias("key"), typed.alias("value"))

    point = {"measurement": F.substring_index("head", ",", 1), "tags": F.map_from_entries("tags_"), "fields": F.map_from_entries(F.transform("pairs", field)), "time_ns": F.col("at")}
    return out.select("value", "line", "text", "plain", *(F.when(F.col("plain"), x).alias(n) for n, x in point.items()))


def parsed(lines: DataFrame, precision: str = "ns", now_ns: int | None = None) -> DataFrame:
    """Points of a frame of lines (value, line); ``error`` is set on lines that are
    no points. Lines without a time get ``now_ns``. Plain lines are parsed in Spark's own
    functions, those with escaped names, errors and other oddities one by one in Python."""
    if precision not in PRECISIONS:
        raise QueryError(f"unknown precision {precision}")
    multiplier = PRECISIONS[precision]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, number in zip(batch["value"], batch["line"], strict=True):
                try:
                    p = parse_line(text or "", multiplier, now_ns)
                except ValueError as e:
                    rows.append((None, None, None, None, number, f"{e}: {text[:80]}"))
                else:
                    if p:
                        rows.append((p[0], p[1], p[2], p[3], number, None))
            yield pd.DataFrame(rows, columns=["measurement", "tags", "fields", "time_ns", "line", "error"]).astype({"time_ns": "Int64", "line": "Int64"})

    each = _plain_points(lines.select("value", "line"), multiplier, now_ns)
    plain = each.where("plain").select("measurement", "tags", "fields", "time_ns", "line", F.lit(None).cast("string").alias("error"))
    odd = each.where("not plain and text <> '' and not startswith(text, '#')").select("value", "line").mapInPandas(run, SCHEMA)
    return plain.union(odd)


def _escaped(x: Column, extra: str = ",= ") -> Column:
    return F.regexp_replace(x, f"([{re.escape(extra)}])", r"\\$1")


def to_lines(df: DataFrame, measurement: str, tags: list[str], fields: dict[str, str]) -> DataFrame:
    """(value): a line for every row that has a field; tags in order of name."""
    col = lambda n: F.col("`" + n.replace("`", "``") + "`")
    key = lambda n: F.lit(re.sub(r"([,= ])", r"\\\1", n))
    head = F.concat(F.lit(re.sub(r"([, ])", r"\\\1", measurement)), *(F.coalesce(F.concat(F.lit(","), key(t), F.lit("="), _escaped(col(t))), F.lit("")) for t in sorted(tags)))
    shown = []
    for f, kind in sorted(fields.items()):
        text = {"integer": F.concat(col(f).cast("string"), F.lit("i")), "string": F.concat(F.lit('"'), F.regexp_replace(col(f), r'(["\\])', r"\\$1"), F.lit('"'))}.get(kind, col(f).cast("string"))
        shown.append(F.concat(key(f), F.lit("="), text))
    body = F.concat_ws(",", *shown)
    return df.select(F.concat(head, F.lit(" "), body, F.lit(" "), F.col("time_ns").cast("string")).alias("value"), body.alias("_b")).where("_b <> ''").drop("_b")
