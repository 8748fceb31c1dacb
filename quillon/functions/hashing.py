"""Canonical JSON, record hashes, content hashes and ULID times."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the content hash: two 32-bit lanes over UTF-16 units, and their common prime.
SEEDS, PRIME = (0x811C9DC5, 0xC4CCD795), 0x01000193
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def number_text(x: float) -> str:
    """A finite double as JavaScript writes it: the shortest digits that read back, an exponent below 1e-6 and from 1e21 on."""
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits))
    point = len(text) + exponent  # where the decimal point stands
    text = text.rstrip("0")
    if len(text) <= point <= 21:
        out = text + "0" * (point - len(text))
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + out


def canonical(value) -> str:
    """JSON with keys sorted by UTF-16 units and no spaces; doubles as ``number_text`` has them, those that aren't finite as null."""
    if isinstance(value, float):
        return number_text(value) if math.isfinite(value) else "null"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def content_hash(value) -> str:
    units = canonical(value).encode("utf-16-le", "surrogatepass")
    out = ""
    for lane in SEEDS:
        for i in range(0, len(units), 2):
            lane = ((lane ^ (units[i] | units[i + 1] << 8)) * PRIME) & 0xFFFFFFFF
        out += f"{lane:08x}"
    return out


def json_hashes(column: str) -> Column:
    """The record hash of JSON strings, whatever their key order and spacing."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.sha256(canonical(json.loads(v)).encode()).hexdigest()[:16])

    return run(column)


def _string_json(text: Column) -> Column:
    """A string as JSON: quotes, backslashes and control characters escaped, all others as they are."""

    def escaped(c: Column) -> Column:
        return F.when(c.isin('"', "\\"), F.concat(F.lit("\\"), c)).when(c.isin(*"\b\f\n\r\t"), F.concat(F.lit("\\"), F.translate(c, "\b\f\n\r\t", "bfnrt"))).when(F.ascii(c) < 32, F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(c)), 4, "0")))).otherwise(c)

    inner = F.when(text.rlike(r'["\x5C\x00-\x1F]'), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), escaped), "")).otherwise(text)
    return F.concat(F.lit('"'), inner, F.lit('"'))


def _bound(values: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a one-element array stands in for a binding."""
    return F.element_at(F.transform(F.array(values), use), 1)


def _shortest(x: Column) -> Column:
    """The shortest digits of a double that read back, in Java's form. Java before version 19 rarely gives one too many, or not the nearest, by itself;
    Jackson's writer, which Spark brings along, doesn't, but has two digits at least where one would do for the two least doubles."""
    text = F.reflect(F.lit("com.fasterxml.jackson.core.io.NumberOutput"), F.lit("toString"), x, F.lit(True))
    return F.when(text == "4.9E-324", "5.0E-324").when(text == "9.9E-324", "1.0E-323").otherwise(text)


def _double_json(x: Column) -> Column:
    """``number_text`` of a column of finite doubles."""

    def parts(text: Column) -> Column:
        digits, power = F.regexp_replace(F.regexp_extract(text, "^([0-9.]+)", 1), "[.]", ""), F.coalesce(F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        return F.struct(F.trim(digits, F.lit("0")).alias("short"), (F.length(F.regexp_extract(text, "^([0-9]+)", 1)) + power - F.length(digits) + F.length(F.ltrim(digits, F.lit("0")))).alias("point"))

    def written(p: Column) -> Column:
        short, point, n = p["short"], p["point"], F.length(p["short"])
        after = lambda start: F.substring(short, start, n)
        out = F.when((n <= point) & (point <= 21), F.concat(short, F.repeat(F.lit("0"), point - n))).when((point > 0) & (point <= 21), F.concat(F.substring(short, F.lit(1), point), F.lit("."), after(point + 1)))
        exponent = F.concat(F.substring(short, 1, 1), F.when(n > 1, F.concat(F.lit("."), after(F.lit(2)))).otherwise(""), F.when(point > 0, "e+").otherwise("e"), (point - 1).cast("string"))
        return out.when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), short)).otherwise(exponent)

    out = _bound(_shortest(F.abs(x)), lambda text: _bound(parts(text), written))
    size = F.abs(x)
    # most numbers are whole, or of a size that Java writes without an exponent too
    whole, plain = (x == F.floor(x)) & (size < 1e15), (size >= 1e-3) & (size < 1e7)
    text = x.cast("string")
    own = F.when(F.length(text) <= 16, text).otherwise(_shortest(x))  # no two decimals of 15 digits are one double
    return F.when(whole, x.cast("long").cast("string")).when(plain, own).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), out))


def value_json(x: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a column of this type, null included: what ``canonical`` gives for the same value."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        cells = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), value_json(x[f.name], f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: value_json(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        wide = x.cast("double")
        out = F.when(~F.isnan(wide) & (F.abs(wide) < F.lit(float("inf"))), _double_json(wide))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        out = x.cast("string")
    elif isinstance(kind, T.StringType):
        out = _string_json(x)
    else:
        plain = F.to_json(F.struct(x.alias("s")))
        out = F.substring(plain, F.lit(6), F.length(plain) - 6)
    return F.when(x.isNull(), "null").otherwise(F.coalesce(out, F.lit("null")))


def record_json(df: DataFrame, columns: list[str]) -> Column:
    """Canonical JSON of columns of ``df``, nulls kept."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = [F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ":"), value_json(F.col(f"`{c}`"), kinds[c])) for c in sorted(columns, key=lambda c: c.encode("utf-16-be"))]
    return F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))


def record_hash(df: DataFrame, columns: list[str]) -> Column:
    return F.substring(F.sha2(record_json(df, columns), 256), 1, 16)


#: Positions whose ids are hashed together.
CHUNK = 4096


def result_hash(result, position: str, id_column: str):
    """One row (result_hash) of a result's ids in the order of ``position`` (long): a digest of each run of ``CHUNK`` positions, then one of
    the digests, so that no task gathers all ids."""
    runs = result.groupBy(F.expr(f"{position} div {CHUNK}").alias("run")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("pos"), F.col(id_column).cast("string").alias("id")))).alias("ids"))
    digests = runs.select("run", F.sha2(F.array_join("ids.id", "|"), 256).alias("digest"))
    return digests.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "digest"))), lambda x: x["digest"]), "|"), 256).alias("result_hash"))


def folded_hash(text: Column) -> Column:
    """The content hash of canonical JSON text, folded in the JVM over its UTF-16 units."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("long"))
    lanes = [F.aggregate(units, F.lit(seed).cast("long"), lambda h, u: h.bitwiseXOR(u) * F.lit(PRIME) % F.lit(1 << 32)) for seed in SEEDS]
    return F.concat(*[F.lower(F.lpad(F.hex(lane), 8, "0")) for lane in lanes])


def ulid_millis(column: Column) -> Column:
    """The time part of a ULID, in milliseconds."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.call_function("locate", F.substring(column, i, F.lit(1)), F.lit(CROCKFORD)) - 1)
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a * 32 + x)


def ulid(millis: Column, randomness: Column) -> Column:
    """A ULID of a time and 16 characters drawn from a hash of ``randomness``: the same row gets the same one again."""
    digit = lambda number: F.substring(F.lit(CROCKFORD), (number + 1).cast("int"), F.lit(1))
    time = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: digit(F.floor(millis / F.pow(F.lit(32.0), 9 - i)) % 32))
    nibbles = F.sha2(randomness.cast("string"), 256)
    rest = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: digit(F.conv(F.substring(nibbles, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % 32))
    return F.concat(F.array_join(time, ""), F.array_join(rest, ""))
