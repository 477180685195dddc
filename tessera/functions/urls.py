"""URL functions as columns: parts, validity, domain, page test, normal form; JVM expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query, fragment (RFC 3986, appendix B)
SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
ASSETS = tuple("pdf zip png jpg jpeg gif svg webp ico css js mp3 mp4 woff woff2 ttf exe".split())
_HOST = r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::(\d*))?$"


def parts(url: Column) -> Column:
    """struct(scheme, user, host, port, path, query): host in lower case, port null if none or not a number."""

    def piece(k: int) -> Column:
        return F.regexp_extract(url, SPLIT, k)

    authority = piece(2)
    host = F.lower(F.regexp_extract(authority, _HOST, 1))
    return F.struct(
        F.lower(piece(1)).alias("scheme"), authority.contains("@").alias("user"), F.regexp_replace(host, r"^\[|\]$", "").alias("host"),
        F.regexp_extract(authority, _HOST, 2).try_cast("int").alias("port"), piece(3).alias("path"), piece(4).alias("query"),
    )


def is_valid(url: Column) -> Column:
    """Absolute http or https, with a host and a port in range, without credentials, white space or back slashes; null is not."""
    p = parts(url)
    clean = ~url.rlike(r"[\s\x00-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\\]")
    port = F.regexp_extract(F.regexp_extract(url, SPLIT, 2), r":([^:\]]*)$", 1)
    in_range = (port == "") | F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False))
    return F.coalesce(clean & p["scheme"].isin("http", "https") & (p["host"] != "") & ~p["user"] & in_range, F.lit(False))


def domain_of(url: Column) -> Column:
    return parts(url)["host"]


def allowed(url: Column, domains: Sequence[str]) -> Column:
    """The host is one of `domains`, exactly, on the scheme's own port."""
    p = parts(url)
    own = F.when(p["scheme"] == "http", 80).otherwise(443)
    return F.coalesce(p["host"].isin([d.lower() for d in domains]) & (p["port"].isNull() | (p["port"] == own)), F.lit(False))


def is_page(url: Column) -> Column:
    """The path does not end like a file of another kind."""
    return ~F.lower(parts(url)["path"]).rlike(r"\.(?:" + "|".join(ASSETS) + ")$")


def _percent(text: Column) -> Column:
    """Escapes in upper case; those of unreserved characters are undone."""
    bits = F.split(text, "%")

    def fixed(x: Column) -> Column:
        code = F.upper(F.substring(x, 1, 2))
        char = F.char(F.conv(code, 16, 10).cast("int"))
        good = code.rlike("^[0-9A-F]{2}$")
        return F.when(~good, F.concat(F.lit("%"), x)).when((F.conv(code, 16, 10).cast("int") < 128) & char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, F.substring(x, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), code, F.substring(x, 3, 1 << 30)))

    return F.concat(F.get(bits, F.lit(0)), F.array_join(F.transform(F.slice(bits, 2, F.greatest(F.size(bits) - 1, F.lit(0))), fixed), ""))


def normalize(url: Column) -> Column:
    """The identity of an absolute URL, null if it is not valid: scheme and host in lower case, own port and fragment dropped, "/" for no path.

    Slashes and the order of the query stay, as both can mean something to a server.
    """
    trimmed = F.trim(url)
    p = parts(trimmed)
    own = F.when(p["scheme"] == "http", 80).otherwise(443)
    host = F.when(p["host"].contains(":"), F.concat(F.lit("["), p["host"], F.lit("]"))).otherwise(p["host"])
    port = F.when(p["port"].isNull() | (p["port"] == own), "").otherwise(F.concat(F.lit(":"), p["port"].cast("string")))
    path = F.when(p["path"] == "", "/").otherwise(_percent(p["path"]))
    query = F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), _percent(p["query"])))
    return F.when(is_valid(trimmed), F.concat(p["scheme"], F.lit("://"), host, port, path, query))


def document_name(url: Column, content_hash: Column) -> Column:
    """The name of a crawled page."""
    return F.concat(F.lit("web-"), F.sha2(url, 256), F.lit("-"), content_hash)


def point_id(source: Column, chunk_id: Column) -> Column:
    """The version 5 UUID, in the URL name space, of source::chunk_id."""
    space = "6ba7b8119dad11d180b400c04fd430c8"
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.concat(source, F.lit("::"), chunk_id).cast("binary")))
    high = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(high, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))
