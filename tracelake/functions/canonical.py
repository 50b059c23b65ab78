"""Canonical JSON, content-addressed ids and fingerprints.

Two JSON texts with the same value have one canonical form: keys sorted, no white
space, numbers and strings printed as ECMAScript prints them.  An event's id is the
SHA-256 of the canonical form of its identity fields.
"""

from __future__ import annotations

import json
import math

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tracelake.functions.workers import slices, trim

#: The schema that new events name; it is part of their identity, so events of another ledger keep theirs.
SCHEMA = "tracelake/v1"
ID_PREFIX = "ev1-"


def number(x: float | int) -> str:
    """A number as ECMAScript prints a double."""
    try:
        x = float(x)
    except OverflowError:
        return "null"
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    mantissa, _, exponent = f"{x!r}".partition("e") if "e" in repr(x) else (repr(x), "", "0")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0") or "0"
    if 0 < point <= 21:
        text = digits.ljust(point, "0")
        text = text[:point] + ("." + text[point:] if len(text) > point else "")
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        e = point - 1
        text = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + text


def _rank(key: str):
    """Keys that are array indices come first by number, the others by UTF-16 code units."""
    if key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < 2**32 - 1:
        return (0, int(key), b"")
    return (1, 0, key.encode("utf-16-be", "surrogatepass"))


def dumps(value) -> str:
    """The canonical form of a parsed JSON value."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(value[k])}" for k in sorted(value, key=_rank)) + "}"


def canonical(text: str | None) -> str | None:
    """The canonical form of a JSON text; null for null and for what is no JSON."""
    try:
        return None if text is None else dumps(json.loads(text))
    except (ValueError, RecursionError):
        return None


def _canonical(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    try:
        for texts in batches:
            made = [pa.array([canonical(t) for t in s.to_pylist()], pa.string()) for s in slices(texts)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.string())
    finally:
        trim()


def canonical_json(text: Column | str) -> Column:
    """The canonical form of a column of JSON texts, batch by batch; null for null and for what is no JSON."""
    return arrow_udf(_canonical, "string")(text)


def quoted(text: Column) -> Column:
    """A string as a JSON string, by Spark itself; null stays null."""
    made = F.to_json(F.struct(text.alias("a")))
    return F.when(text.isNotNull(), made.substr(F.lit(6), F.length(made) - 6))


def fingerprint(text: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def json_object(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object of fields that are JSON texts themselves, in the given order; null fields are left out."""
    return F.concat(F.lit("{"), F.array_join(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in fields]), ","), F.lit("}"))


def identity_json(content: str = "content_json") -> Column:
    """The canonical identity of an event row; everything left out of it may differ between copies."""
    links = F.transform("links", lambda x: json_object([("rel", quoted(x["rel"])), ("target", quoted(x["target"]))]))
    c = F.col
    conversation = json_object([("id", quoted(c("conversation.id"))), ("parent", quoted(c("conversation.parent"))), ("seq", c("conversation.seq").cast("string"))])
    return json_object(
        [
            ("actor", json_object([("id", quoted(c("actor.id"))), ("type", quoted(c("actor.type")))])),
            ("content", c(content)),
            ("conversation", F.when(c("conversation.id").isNotNull(), conversation)),
            ("kind", quoted(c("kind"))),
            ("links", F.when(F.size("links") > 0, F.concat(F.lit("["), F.array_join(links, ","), F.lit("]")))),
            ("media_type", quoted(c("media_type"))),
            ("occurred_at", quoted(c("occurred_at"))),
            ("schema", quoted(c("schema"))),
            ("session_id", quoted(c("producer.session_id"))),
            ("source", quoted(c("producer.source"))),
        ]
    )


def event_id(content: str = "content_json") -> Column:
    return F.concat(F.lit(ID_PREFIX), F.sha2(identity_json(content).cast("binary"), 256))
