"""Judging errors, retries and requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell passing errors from lasting ones.
RETRY_WORDS = ("bad gateway", "gateway timeout", "timeout", "timed out", "connection reset", "connection aborted", "temporarily unavailable",
               "service unavailable", "201007", "502", "503", "504", "5xx")
PAYLOAD_WORDS = ("payload exceeds limit after urlencode", "image size exceeds maximum limit", "http status=413", "413 request entity too large")
# Error classes and those derived from them, since an error arrives by the name of its own class.
VALUE_TYPES = ("ValueError", "JSONDecodeError", "UnicodeError", "UnicodeDecodeError", "UnicodeEncodeError", "UnicodeTranslateError",
               "InvalidURL", "InvalidHeader", "InvalidJSONError", "InvalidProxyURL", "InvalidSchema", "MissingSchema")
LASTING_TYPES = (*VALUE_TYPES, "FileNotFoundError", "PermissionError", "NotImplementedError")
NETWORK_TYPES = ("TimeoutError", "ConnectionError", "ConnectionResetError", "ConnectionAbortedError", "ConnectionRefusedError", "BrokenPipeError",
                 "Timeout", "ReadTimeout", "ConnectTimeout", "ProxyError", "SSLError")
ALLOWED = {"scene": ("general", "license"), "data_type": ("uri", "url", "file"), "endpoint": ("pdf", "multilang"), "language": ("zh", "ko")}


def any_word(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def retryable(error_type: Column, status: Column, message: Column) -> Column:
    text = F.lower(message)
    return (
        F.when(error_type.isin(*VALUE_TYPES), False).when(status.between(500, 599), True).when(status.between(400, 499), False)
        .when(error_type.isin(*NETWORK_TYPES), True).when(any_word(text, RETRY_WORDS), True).otherwise(False)
    )


def retryable_step(error_type: Column) -> Column:
    """Coarse form for whole steps: only wrong input, missing files and the like are lasting."""
    return ~error_type.isin(*LASTING_TYPES)


def payload_limit(message: Column) -> Column:
    return any_word(F.lower(message), PAYLOAD_WORDS)


def summarize(error_type: Column, message: Column, longest: int = 240) -> Column:
    line = F.trim(F.replace(F.concat(error_type, F.lit(": "), message), F.lit("\n"), F.lit(" ")))
    if longest <= 0:
        return line
    return F.when(F.length(line) > longest, F.concat(F.substring(line, 1, longest), F.lit("..."))).otherwise(line)


def backoff(attempt: Column, base: float = 0.5, factor: float = 2.0, top: float = 4.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), F.greatest(attempt - 1, F.lit(0))), F.lit(top))


def model_allowed(name: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    tokens = F.contains(v, F.lit("doubao")) & F.contains(v, F.lit("seed")) & F.contains(v, F.lit("1-8"))
    return F.when(v == "", False).when(v.startswith("ep-"), True).otherwise(tokens | (F.contains(v, F.lit("doubao")) & F.contains(v, F.lit("1.8"))))


def validate(value: Column, field: str) -> Column:
    """``ok``, ``blank`` (a language may be) or the reason why a request's value is refused; a ``url`` must begin with http(s)://."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    if field == "url":
        return F.when(v.rlike("^https?://"), "ok").otherwise("bad url")
    blank = F.lit("blank") if field == "language" else F.lit(f"bad {field}")
    return F.when(v == "", blank).when(v.isin(*ALLOWED[field]), "ok").otherwise(f"bad {field}")


def encoded_size(data: Column) -> Column:
    """Length of the bytes as URL-encoded base64."""
    return F.length(F.url_encode(F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))))


def _is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def route(data_type: Column, source: Column, is_file: Column, public_domain: str | None) -> tuple[Column, Column, Column]:
    """(how to send, address, file kind) of an OCR input."""
    web = source.rlike("^https?://")
    shared = F.concat(F.lit(f"https://{(public_domain or '').strip('/')}/"), F.ltrim(source, F.lit("/")))
    keyed = F.when(F.lit(bool(public_domain)), F.lit("url")).otherwise(F.lit("error"))
    how = (
        F.when(data_type == "file", F.when(is_file, "file").otherwise("error")).when(data_type == "url", F.when(web, "url").otherwise("error"))
        .when(is_file, "file").when(web, "url").otherwise(keyed)
    )
    address = F.when(how == "url", F.when(web, source).otherwise(shared)).when(how == "file", source)
    path = F.when(how == "url", F.regexp_extract(address, r"^https?://[^/?#]*([^?#]*)", 1)).otherwise(address)
    return how, address, F.when(_is_pdf(path), "pdf").otherwise("image")
