"""Column functions over text: normal forms, terms, scrubbing, transcripts, templates and keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words that count as structured terms; a caller adds the names of its own tools
COMMAND_WORDS = [
    "git", "gh", "codex", "pytest", "python", "python3", "pip", "uv", "npm", "npx", "pnpm", "yarn", "cargo",
    "go", "make", "docker", "kubectl", "terraform", "systemctl", "ssh", "curl", "rg", "grep", "find", "sed", "awk",
]
# fixed values: path parts that say nothing about a project
PATH_STOP = ["home", "tmp", "users", "user"]
# fixed values: namespace of stable document ids
DOCUMENT_NAMESPACE = "e3f94d3f97695acb9cab5a29f8d2cae6"
# fixed values: limits in characters
MAX_TRANSCRIPT, HEAD_SHARE, MAX_DOCUMENT, MAX_MEMORY, MAX_DIAGNOSTIC, MAX_SUMMARY = 150_000, 0.6, 200_000, 800_000, 8000, 500

_MARKED = {chr(c): b for c in range(0xC0, 0x3000) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and len(b := "".join(x for x in d if unicodedata.category(x) != "Mn")) == 1}
_FROM, _TO = "".join(_MARKED), "".join(_MARKED.values())


def fold(text: Column) -> Column:
    """Lower case without accents; stays in the JVM. Precomposed letters lose their marks by a table, others by pattern; ASCII has none."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(F.translate(low, _FROM, _TO), r"\p{Mn}+", ""))


def tokens(text: Column) -> Column:
    """Words of letters, digits and private characters, lower-cased and without accents, in order; null has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


@F.pandas_udf(T.StringType())
def normal_query(text: pd.Series) -> pd.Series:
    """NFKC and case-folded, backslashes as slashes, white space collapsed."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().replace("\\", "/").split()))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def path_tokens(text: Column) -> Column:
    """Normal words of a path or text, with slashes and hyphens as spaces, without . and .."""
    words = F.split(F.trim(F.regexp_replace(F.translate(normal_query(text), "/-", "  "), " +", " ")), " ")
    return F.filter(words, lambda w: ~w.isin("", ".", ".."))


def query_words(text: Column, most: int = 32) -> Column:
    """First words of the normal query; an underscore does not end a word."""
    return F.slice(F.regexp_extract_all(normal_query(text), F.lit(r"(?U)\w+"), F.lit(0)), 1, most)


def structured_terms(text: Column, more: tuple[str, ...] = ()) -> Column:
    """Issue keys, then command words and ``more`` of them; case-folded, each once, in order of appearance."""
    whole = _nfkc(text)
    keys = F.transform(F.regexp_extract_all(whole, F.lit(r"(?<![A-Za-z0-9])([A-Z][A-Z0-9]+-\d+)(?![A-Za-z0-9])"), F.lit(1)), F.lower)
    found = F.regexp_extract_all(casefold(whole), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.concat(keys, F.array_intersect(found, F.array(*map(F.lit, [*COMMAND_WORDS, *more])))))


def scrub(text: Column, home: str | None = None) -> Column:
    """Text without private keys, bearer tokens, connection strings and assigned secrets; labels stay.

    White space and ends of words are those of all scripts.
    """
    out = text
    for pattern, by in (  # fixed values: what counts as a secret
        (r"(?isU)-----BEGIN [^-]+-----.*?-----END [^-]+-----", "<redacted>"),
        (r"(?iU)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer <redacted>"),
        (r"(?iU)\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis)://[^\s<>]+", "<redacted>"),
        (r"(?imU)\b((?:[A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIALS?)|(?:AWS|GITHUB|OPENAI|ANTHROPIC)_[A-Z0-9_]+)\s*=)\s*[^\s#;,]+", "$1 <redacted>"),
        (r"(?iU)\b((?:api[_-]?key|access[_-]?token|refresh[_-]?token|secret|password|passwd|token)\s*[:=]\s*)[^\s#;,]+", "$1<redacted>"),
    ):
        out = F.regexp_replace(out, pattern, by)
    home = (home or "").rstrip("/")
    return F.replace(out, F.lit(home), F.lit("<home>")) if home else out


def _micros(stamp: Column) -> Column:
    """Microseconds since 1970 of an ISO time; UTC where it has no zone, whatever the session's zone is. Null where it is none."""
    said = F.trim(stamp)
    zoned = F.when(said.rlike(r"(?i)(z|[+-]\d{2}(:?\d{2})?)$") & said.contains(":"), said).when(said.contains(":"), F.concat(said, F.lit("Z"))).otherwise(F.concat(said, F.lit("T00:00:00Z")))
    return F.unix_micros(F.try_to_timestamp(F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}"), zoned)))


def epoch(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO time, UTC where it has no zone; 0 where it is none."""
    return F.coalesce(_micros(stamp) / 1e6, F.lit(0.0))


def iso_utc(micros: Column) -> Column:
    """ISO time with a Z of microseconds since 1970, with six digits of a second where it is no whole one."""
    day, rest = F.floor(micros / F.lit(86_400_000_000)), F.pmod(micros, F.lit(86_400_000_000))
    second = F.floor(rest / 1_000_000)
    clock = F.format_string("T%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    part = rest % 1_000_000
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), clock, F.when(part > 0, F.format_string(".%06d", part)).otherwise(F.lit("")), F.lit("Z"))


def utc_stamp(stamp: Column) -> Column:
    """ISO time in UTC with a Z, fractions of seconds kept; null where it is none."""
    return iso_utc(_micros(stamp))


def project_slug(cwd: Column, fallback: Column) -> Column:
    return F.coalesce(F.when(cwd != "", F.translate(cwd, "/", "-")), fallback)


def stable_id(kind: Column, locator: Column) -> Column:
    """Name-based UUID (version 5) of ``kind:locator``."""
    h = F.sha1(F.concat(F.unhex(F.lit(DOCUMENT_NAMESPACE)), F.encode(F.concat_ws(":", kind, locator), "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def transcript(messages: Column) -> Column:
    """Rendered messages, an array of (role, text, timestamp) in order; each is a header, its text and an empty line."""
    def lines(m: Column) -> Column:
        who = F.when(m["role"] == "user", F.lit("USER")).otherwise(F.lit("ASSISTANT"))
        stamp = F.when(F.coalesce(m["timestamp"], F.lit("")) != "", F.concat(F.lit(" ["), m["timestamp"], F.lit("]"))).otherwise(F.lit(""))
        return F.concat(F.lit("--- "), who, stamp, F.lit(" ---\n"), F.coalesce(m["text"], F.lit("")), F.lit("\n"))

    return F.array_join(F.transform(messages, lines), "\n")


def truncate_middle(text: Column, most: int = MAX_TRANSCRIPT, head_share: float = HEAD_SHARE) -> Column:
    head = int(most * head_share)
    note = F.concat(F.lit("\n\n... [TRUNCATED "), (F.length(text) - most).cast("string"), F.lit(" chars in middle] ...\n\n"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), note, F.right(text, F.lit(most - head))))


def fill(template: Column | str, **values: Column) -> Column:
    """The template with each {{name}} replaced; null and empty values say unknown."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(F.when(value != "", value), F.lit("unknown")))
    return out


def key_of(*parts: Column) -> Column:
    """SHA-256 of the parts with a NUL between them; a null part is empty."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def preview_slug(name: Column) -> Column:
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9-]+", "-"), "^-+|-+$", ""), 1, 50)
    return F.when(F.coalesce(slug, F.lit("")) == "", F.lit("suggestion")).otherwise(slug)


def index_target(line: Column) -> Column:
    """File that an index line links to; null if it is no link line."""
    found = F.regexp_extract(line, r"\]\(([^)]+\.md)\)", 1)
    return F.when(found != "", found)


def json_body(raw: Column) -> Column:
    """The JSON text of a completion, with or without a code fence around it."""
    text = F.trim(raw)
    inner = F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)```", 1)
    return F.trim(F.when(text.startswith("```") & (inner != ""), inner).otherwise(text))


def bounded(text: Column, most: int = 256) -> Column:
    return F.substring(text, 1, most)
