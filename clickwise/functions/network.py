"""Client IP extraction (FN-3), stub country rule (FN-5), IP hashing (FN-6)."""

from pyspark.sql import Column, functions as F

from clickwise.functions.text import _c, is_blank, java_strip

# Address prefixes the stub resolver reports as LOCAL.
LOCAL_PREFIXES = ("127.", "10.", "192.168.")
LOCAL_EXACT = ("::1",)
LOCAL = "LOCAL"
DEFAULT_COUNTRY = "US"
UNKNOWN_IP_HASH = "unknown"


def extract_client_ip(x_forwarded_for, x_real_ip, remote_addr) -> Column:
    """First X-Forwarded-For entry (stripped), else X-Real-IP (stripped), else remote address."""
    xff, real = _c(x_forwarded_for), _c(x_real_ip)
    return (F.when(~is_blank(xff), java_strip(F.substring_index(xff, ",", 1)))
             .when(~is_blank(real), java_strip(real))
             .otherwise(_c(remote_addr)))


def geo_country_stub(ip) -> Column:
    """Stub country: null stays null, private/loopback is LOCAL, anything else US."""
    ip = _c(ip)
    local = F.lit(False)
    for p in LOCAL_PREFIXES:
        local = local | ip.startswith(p)
    for e in LOCAL_EXACT:
        local = local | (ip == F.lit(e))
    return F.when(ip.isNull(), F.lit(None).cast("string")).when(local, F.lit(LOCAL)).otherwise(F.lit(DEFAULT_COUNTRY))


def hash_ip(raw_ip) -> Column:
    """Lower-hex SHA-256 of the UTF-8 address; null or blank gives 'unknown'."""
    ip = _c(raw_ip)
    return F.when(is_blank(ip), F.lit(UNKNOWN_IP_HASH)).otherwise(F.sha2(ip, 256))


def ipv4_to_long(ip) -> Column:
    """Dotted IPv4 text to its 32-bit number; anything else gives null.

    ``get`` and ``try_cast`` yield null instead of failing under ANSI mode,
    whatever order the engine evaluates the guard and the value in."""
    ip = _c(ip)
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$")
    value = F.lit(0).cast("long")
    for i in range(4):
        octet = F.get(parts, i).try_cast("long")
        ok = ok & (octet <= 255)
        value = value * 256 + octet
    return F.when(ok, value)


def ipv4_key(number) -> Column:
    """An IPv4 number as 32 hex digits (mapped into the IPv6 space); null beyond 32 bits."""
    n = _c(number)
    return F.when(n.between(0, (1 << 32) - 1), F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(n)), 8, "0")))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: a column used many times would be copied into the plan each time."""
    return F.get(F.transform(F.array(value), use), 0)


def _v6_key(text: Column) -> Column:
    """IPv6 groups (``::`` for a run of zeros) as 32 hex digits; anything else gives null."""
    def groups(half: Column) -> Column:
        return F.when(half.isNull() | (half == ""), F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def filled(x: Column) -> Column:
        known = F.size(x["left"]) + F.size(x["right"])
        zeros = F.when((x["halves"] == 2) & (known <= 7), 8 - known).when((x["halves"] == 1) & (known == 8), 0)
        return F.concat(x["left"], F.array_repeat(F.lit("0"), zeros), x["right"])

    sides = _let(F.split(text, "::"), lambda h: F.struct(
        F.size(h).alias("halves"), groups(F.get(h, 0)).alias("left"), groups(F.get(h, 1)).alias("right")))
    return _let(_let(sides, filled), lambda parts: F.when(
        F.forall(parts, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), "")))


def ip_key(ip) -> Column:
    """IPv4 or IPv6 text (``::``, a dotted tail and a zone included) as 32 hex digits; anything else gives null."""
    def v4(text: Column) -> Column:
        return _let(ipv4_to_long(text), ipv4_key)

    def grouped(text: Column) -> Column:
        """A dotted tail becomes two groups."""
        tail = F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        return F.when(tail == "", text).otherwise(_let(v4(tail), lambda last: F.concat(
            F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(last, 25, 4), F.lit(":"), F.substring(last, 29, 4))))

    return _let(_c(ip), lambda x: F.coalesce(v4(x), _let(_let(F.lower(F.regexp_replace(x, r"%.+$", "")), grouped), _v6_key)))
