"""Column functions on ids, times, attributes and values of telemetry records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _id(text: Column, size: int) -> Column:
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), "^0[xX]", ""), "[- ]", ""))
    return F.when(bare.rlike(f"^[0-9a-f]{{{size}}}$") & ~bare.rlike("^0+$"), bare)


def normalize_trace_id(text: Column) -> Column:
    """32 lower-case hexadecimal digits; null for another length, other signs or all zeros."""
    return _id(text, 32)


def normalize_span_id(text: Column) -> Column:
    return _id(text, 16)


def to_hex_id(text: Column, size: int) -> Column:
    """An id that comes as hexadecimal digits of the right length, or else as base64; null for anything else."""
    bytes_ = F.try_to_binary(text, F.lit("base64"))
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{size}}}$"), F.lower(text)).when(F.octet_length(bytes_) * 2 == size, F.lower(F.hex(bytes_)))


def parse_trace_target(text: Column) -> Column:
    """Struct of trace_id and span_id from a bare trace id or a W3C traceparent; fields are null where none is found."""
    parent = r"^\s*[0-9a-fA-F]{2}-([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-[0-9a-fA-F]{2}\s*$"
    full = text.rlike(parent)
    trace = F.when(full, normalize_trace_id(F.regexp_extract(text, parent, 1))).otherwise(normalize_trace_id(text))
    return F.struct(trace.alias("trace_id"), F.when(full, normalize_span_id(F.regexp_extract(text, parent, 2))).alias("span_id"))


def nano_to_ms(nanos: Column) -> Column:
    """Milliseconds of a count of nanoseconds (text or number), the part below a millisecond kept; null for other text."""
    n = nanos.try_cast("decimal(20,0)")
    return F.floor(n / 1_000_000).cast("double") + (n % 1_000_000).cast("double") / 1_000_000


def ms_to_nano(ms: Column) -> Column:
    whole = F.floor(ms)
    return whole.cast("decimal(20,0)") * 1_000_000 + F.round((ms - whole) * 1_000_000).cast("decimal(20,0)")


def _names(value: Column, names: list[str], prefix: str, other: str) -> Column:
    """Name of a number from names, or of a name with or without its prefix."""
    text = F.upper(value.cast("string"))
    out = F.lit(other)
    for k, name in reversed(list(enumerate(names))):
        out = F.when((text == str(k)) | (text == name) | (text == prefix + name), name).otherwise(out)
    return out


def span_kind(value: Column) -> Column:
    return _names(value, ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"], "SPAN_KIND_", "UNSPECIFIED")


def status_code(value: Column) -> Column:
    return _names(value, ["UNSET", "OK", "ERROR"], "STATUS_CODE_", "UNSET")


def attr(attrs: Column, *keys: str) -> Column:
    """The first of keys that attrs has with a value that is not empty."""
    return F.coalesce(*(F.when(F.element_at(attrs, k) != "", F.element_at(attrs, k)) for k in keys))


def code_location(attrs: Column) -> Column:
    """Struct of filepath, line, column, function from the code attributes, null without a path."""
    path = attr(attrs, "code.file.path", "code.filepath")
    number = lambda *k: attr(attrs, *k).try_cast("bigint")
    return F.when(path.isNotNull(), F.struct(path.alias("filepath"), number("code.line.number", "code.lineno").alias("line"), number("code.column.number", "code.column").alias("column"), attr(attrs, "code.function.name", "code.function").alias("function")))


def epoch_to_ms(text: Column) -> Column:
    """Milliseconds of an epoch number, whose size tells its unit, or of an ISO time."""
    n = text.try_cast("double")
    size = F.abs(n)
    number = F.when(size < 1e11, n * 1000).when(size < 1e14, n).when(size < 1e17, n / 1000).otherwise(n / 1_000_000)
    return F.when(n.isNotNull(), number).otherwise(F.unix_micros(F.try_to_timestamp(text)) / 1000)


def severity_label(number: Column) -> Column:
    """TRACE to FATAL for 1 to 24, four numbers each; empty below."""
    out = F.when(number < 1, "")
    for k, name in enumerate(["TRACE", "DEBUG", "INFO", "WARN", "ERROR"]):
        out = out.when(number < 5 + 4 * k, name)
    return out.otherwise("FATAL")


# Severity words and their numbers.
SEVERITY = {
    "trace": 1, "trce": 1, "verbose": 1, "finest": 1,
    "debug": 5, "dbug": 5, "fine": 5,
    "info": 9, "information": 9, "informational": 9, "notice": 9,
    "warn": 13, "warning": 13,
    "error": 17, "err": 17, "fail": 17, "failure": 17, "severe": 17,
    "fatal": 21, "critical": 21, "crit": 21, "alert": 21, "emerg": 21, "emergency": 21, "panic": 21,
}


def severity_number(value: Column) -> Column:
    """0 to 24 from a number, a severity word, or a text that begins with one and a colon."""
    number = value.try_cast("double")
    word = F.lower(F.trim(value))
    words = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    head = F.element_at(words, F.regexp_extract(word, r"^([a-z]+)\s*:", 1))
    return F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(24), F.floor(number)))).otherwise(F.coalesce(F.element_at(words, word), head, F.lit(0))).cast("int")


_DURATION = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(us|µs|ms|s|m|h)?\s*$"


def parse_duration_ms(text: Column) -> Column:
    """Milliseconds of "250ms", "1.5s", "2m", "3h", "10us"; a bare number is milliseconds, other text null."""
    unit = F.regexp_extract(text, _DURATION, 2)
    scale = F.when(unit.isin("us", "µs"), 1e-3).when(unit == "s", 1e3).when(unit == "m", 6e4).when(unit == "h", 3.6e6).otherwise(1.0)
    return F.when(text.rlike(_DURATION), F.regexp_extract(text, _DURATION, 1).try_cast("double") * scale)


def attr_number(text: Column) -> Column:
    """The number that a value's text form is, else null."""
    return F.when(F.trim(text) != "", F.trim(text).try_cast("double"))


def summarize_attrs(attrs: Column, size: int = 120) -> Column:
    """"k=v  k=v" in key order, cut with an ellipsis."""
    parts = F.transform(F.array_sort(F.map_keys(attrs)), lambda k: F.concat(k, F.lit("="), F.element_at(attrs, k)))
    text = F.array_join(parts, "  ")
    return F.when(F.char_length(text) > size, F.concat(F.left(text, F.lit(size - 1)), F.lit("…"))).otherwise(text)


def presented_type(kind: Column, monotonic: Column) -> Column:
    """A sum is a counter if monotonic, else an updowncounter; other types keep their name."""
    return F.when(kind == "sum", F.when(F.coalesce(monotonic, F.lit(False)), "counter").otherwise("updowncounter")).otherwise(kind)


def operation_key(name: Column, attrs: Column) -> Column:
    """Name of low cardinality: method and route, else database operation and collection, else the span's name; 200 signs."""
    text = lambda *keys: F.coalesce(*(F.when(F.trim(F.element_at(attrs, k)) != "", F.trim(F.element_at(attrs, k))) for k in keys))
    route, operation = text("http.route"), text("db.operation.name", "db.operation")
    key = F.when(route.isNotNull(), F.concat_ws(" ", text("http.request.method", "http.method"), route)).when(operation.isNotNull(), F.concat_ws(" ", operation, text("db.collection.name", "db.sql.table"))).otherwise(name)
    return F.left(key, F.lit(200))


def classify_target(kind: Column, attrs: Column, peer_is_service: Column | None = None) -> Column:
    """Struct (id, label, type) of the database, queue or external node that a span calls; null if none.

    peer_is_service: whether peer(attrs) is a known service, and so not external.
    """
    db, queue, peer = attr(attrs, "db.system"), attr(attrs, "messaging.system"), peer_of(attrs)
    base = F.coalesce(attr(attrs, "db.namespace", "db.name"), db)
    to = F.coalesce(attr(attrs, "messaging.destination.name", "messaging.destination"), queue)
    node = lambda prefix, a, b, t: F.struct(F.concat_ws(":", F.lit(prefix), a, b).alias("id"), F.concat_ws(": ", a, b).alias("label"), F.lit(t).alias("type"))
    outside = (kind == "CLIENT") & peer.isNotNull() & ~(F.coalesce(peer_is_service, F.lit(False)) if peer_is_service is not None else F.lit(False))
    external = F.struct(F.concat(F.lit("ext:"), peer).alias("id"), peer.alias("label"), F.lit("external").alias("type"))
    return F.when(db.isNotNull(), node("db", db, base, "database")).when(queue.isNotNull(), node("queue", queue, to, "queue")).when(outside, external)


def peer_of(attrs: Column) -> Column:
    return attr(attrs, "peer.service", "server.address", "net.peer.name", "rpc.service")


def truncate_message(text: Column, size: int = 300) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > size, F.concat(F.left(flat, F.lit(size)), F.lit("…"))).otherwise(flat)


UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_GROUP = "[0-9a-fA-F]{1,4}"
_IPV6 = rf"(({_GROUP}:){{7}}{_GROUP}|({_GROUP}(:{_GROUP}){{0,6}})?::({_GROUP}(:{_GROUP}){{0,6}})?)"
IP = rf"^({_IPV4}(:[0-9]{{1,5}})?|{_IPV6}|\[{_IPV6}\](:[0-9]{{1,5}})?)$"
EMAIL = r'^[^\s"<>@]{1,64}@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$'
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def is_hex(s: Column, size: int) -> Column:
    return s.rlike(f"^(0[xX])?[0-9a-fA-F]{{{size},}}$") & F.regexp_replace(s, "^0[xX]", "").rlike("[0-9]")


def is_token(s: Column) -> Column:
    return s.rlike("^[A-Za-z0-9_+/=.-]{20,}$") & s.rlike("[0-9]") & s.rlike("[A-Z]") & s.rlike("[a-z]")


def is_id_segment(s: Column) -> Column:
    """A path segment that differs from entity to entity."""
    return s.rlike("^[0-9]+$") | s.rlike(f"^{UUID}$") | is_hex(s, 8) | is_token(s) | s.rlike(EMAIL)


def has_id_part(name: Column) -> Column:
    parts = F.split(F.left(name, F.lit(256)), r"[\s/?&=,]+")
    return F.exists(parts, lambda p: (p != "") & (is_id_segment(p) | p.rlike(IP)))


def is_time(s: Column) -> Column:
    """An ISO time, or an epoch number of 2000 to 2099 in seconds or a finer unit."""
    seconds = F.left(s, F.lit(10)).try_cast("bigint")
    epoch = s.rlike("^([0-9]{10}|[0-9]{13}|[0-9]{16}|[0-9]{19})$") & (seconds >= 946_684_800) & (seconds < 4_102_444_800)
    return epoch | (s.rlike(ISO_TIME) & F.char_length(s).between(16, 40))


def classify_value(value: Column) -> Column:
    """Class of an attribute value's text: what kind of id, address, time or text it is. Rules in order; 256 signs."""
    s = F.left(value, F.lit(256))
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]{0,15}://[^/?#]*"
    url = s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]{0,15}://") | s.startswith("/")
    path = F.regexp_replace(F.regexp_replace(s, scheme, ""), "[?#].*$", "")
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "other").when(s.rlike(f"^{UUID}$"), "uuid").when(is_time(s), "timestamp")
        .when(s.rlike(r"[\s   ]"), F.when(F.char_length(value) >= 24, "freeText").otherwise("other"))
        .when(s.rlike(IP), "ip").when(s.rlike(EMAIL), "email")
        .when(url & s.rlike(r"\?.*="), "urlQuery").when(url, F.when(F.exists(F.split(path, "/"), lambda p: (p != "") & is_id_segment(p)), "pathId").otherwise("other"))
        .when(s.rlike("^[0-9]{6,}$"), "numericId").when(is_hex(s, 16), "hexId").when(is_token(s), "token").otherwise("other")
    )


ID_CLASSES = ("uuid", "hexId", "numericId", "token", "email", "ip", "timestamp", "urlQuery", "pathId")
