"""Scalar operators: each takes columns and parameters and gives a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_prefix(key: Column, chars: int = 20) -> Column:
    return F.left(key, F.lit(chars))


def secret_key(seed: Column, chars: int = 64) -> Column:
    """A url-safe random key of ``chars`` characters (at most 86); another one at every run."""
    noise = F.sha2(F.concat(seed.cast("string"), F.uuid()), 512)
    return F.left(F.translate(F.base64(F.unhex(noise)), "+/=", "-_"), F.lit(chars))


def cache_key(parts: dict[str, Column], prefix: str = "inference:") -> Column:
    """``prefix`` and the digest of the request as JSON with sorted keys; fields that are null are left out."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256))


def title(name: Column) -> Column:
    """``snake_case`` to words with a capital first letter each."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def reflected(body: Column, payload: Column, mark: str = "script") -> Column:
    """The payload comes back in the body, and it is one that would run."""
    return F.coalesce(F.contains(body, payload) & F.contains(F.lower(payload), F.lit(mark)), F.lit(False))


def json_escaped(text: Column) -> Column:
    """``text`` as it stands inside a JSON string."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(3), F.length(quoted) - 4)


def fill_template(value: Column, payload: Column, place: str = "PAYLOAD") -> Column:
    """Every ``place`` in a nested value (struct, array or map), at any depth, replaced; the result is JSON."""
    return F.replace(F.to_json(value), F.lit(place), json_escaped(payload))


def url_part(url: Column, part: str) -> Column:
    """``scheme``, ``host`` or ``port`` (443 or 80 by the scheme where there is none); null for what isn't a URL."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?"
    get = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    scheme = F.lower(get(1))
    if part == "port":
        return F.coalesce(get(3).cast("int"), F.when(scheme == "https", 443).when(scheme == "http", 80))
    return {"scheme": scheme, "host": F.lower(get(2))}[part]


def url_join(base: Column, path: Column) -> Column:
    """One slash between the base and the path."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")))


def sse_payload(line: Column, mark: str = "data: ", end: str = "[DONE]") -> Column:
    """What a stream's line carries; null if it is no data line or the end mark."""
    own = F.substring(line, F.lit(len(mark) + 1), F.length(line))
    return F.when(F.startswith(line, F.lit(mark)) & (own != end), own)


def with_commas(x: Column, places: int = 0) -> Column:
    return F.format_number(x, places)


def fixed(x: Column, places: int) -> Column:
    """As ``printf`` writes it: the double's exact value is rounded, a tie to the even digit (``format_string`` rounds its shortest
    decimal, ties up). Numbers of over 17 digits end in zeros."""
    d = x.cast("double")
    odd = F.when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf")
    return F.coalesce(odd, F.call_function("format_number", d, F.lit("0" + "." * (places > 0) + "0" * places)))


def padded(x: Column, width: int = 3) -> Column:
    return F.format_string(f"%0{width}d", x)


def month_start(epoch: Column) -> Column:
    """Seconds since 1970 of the first moment of the month, in UTC whatever the session's time zone is."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
    return F.date_diff(F.trunc(day, "month"), F.lit("1970-01-01").cast("date")).cast("long") * 86400


def iso(epoch: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` in UTC whatever the session's time zone is."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
    s = F.pmod(F.floor(epoch), F.lit(86400)).cast("int")
    return F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def zero_vector(size: int = 1536) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), size)


def valid_json(text: Column) -> Column:
    """One JSON value and nothing after it; null is none."""
    alone = F.concat(F.lit("["), text, F.lit("]"))  # readers stop after a value, so what follows must not fit a list
    return F.coalesce(F.try_parse_json(alone).isNotNull() & (F.size(F.from_json(alone, "array<string>")) == 1), F.lit(False))


def try_json(text: Column) -> Column:
    """``object``, ``array``, ``value`` or ``invalid``: what a body is as JSON."""
    kind = F.substring(F.ltrim(text), 1, 1)
    return F.when(~valid_json(text), "invalid").when(kind == "{", "object").when(kind == "[", "array").otherwise("value")


def merged_list(context: Column, message: Column) -> Column:
    """The list with a message after it; a null list is empty."""
    return F.concat(F.coalesce(context, F.array().cast("array<string>")), F.array(message))


def pick(key: Column, choices: list[str]) -> Column:
    """One of ``choices``, spread evenly and the same for the same key."""
    place = F.pmod(F.conv(F.left(F.md5(key.cast("string")), F.lit(7)), 16, 10).cast("long"), F.lit(len(choices)))
    return F.element_at(F.array(*map(F.lit, choices)), (place + 1).cast("int"))


def truthy(x: Column, empty) -> Column:
    """Null where a script would take ``x`` for false."""
    return F.nullif(x, F.lit(empty))
