"""Scalar text functions as Column expressions; Python only where Spark has no counterpart (NFC, full case folding)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Runs of letters, digits and underscores; runs of letters and digits. ``\w`` isn't used: Java's takes in combining marks.
TOKEN, TERM = r"([\p{L}\p{N}_]+)", r"([\p{L}\p{N}]+)"

# Words that mark a language, after folding.
ENGLISH = (
    "the", "of", "and", "to", "that", "is", "was", "were", "for", "with", "as", "on", "by", "are", "this", "these", "those", "from", "which", "what", "why", "how", "when", "where",
    "did", "does", "do", "we", "our", "not", "but", "have", "has", "had", "be", "been", "it", "its", "they", "their", "there", "would", "should", "could", "than", "then", "into",
)
SPANISH = (
    "que", "por", "para", "con", "los", "las", "del", "una", "como", "donde", "cuando", "porque", "sobre", "este", "esta", "estos", "estas", "fue", "fueron", "hace", "desde",
    "hasta", "entre", "mas", "muy", "sin", "tambien", "cual", "quien", "nuestro", "nuestra", "el", "la", "lo", "al", "se", "su", "sus", "es", "un", "si", "ya", "pero", "todo",
)
LEAST_HITS = LEAST_MARGIN = 2
# Accented letters and what they are folded to before markers are looked up.
ACCENTS = ("áéíóúüñàèìòù", "aeiouunaeiou")

# Lower-case letters that case folding changes further, of those that occur in prose.
FOLDS = (("ß", "ss"), ("ς", "σ"), ("ŉ", "ʼn"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))

# Advisory patterns by code, case-insensitive.
ADVISORIES = (
    ("mentions_credential_path", r"(?i)~/\.ssh|~/\.aws|~/\.gnupg|\.env\b|id_rsa|credentials\.json"),
    ("mentions_shell_profile", r"(?i)\.bashrc|\.zshrc|\.bash_profile|\.profile\b"),
    ("mentions_network_tool", r"(?i)\bcurl\b|\bwget\b|\bnc\b|\bscp\b|\brsync\b"),
    ("mentions_encoding_and_transfer", r"(?is)base64.{0,80}(upload|post|send|http)|\b(upload|post|send)\b.{0,80}base64"),
    ("instructs_the_reader_to_ignore_guidance", r"(?i)ignore (all )?(previous|prior|above)|disregard .{0,20}instruction|do not tell|without (telling|informing)"),
)

#: The same patterns as a search takes them: a look at the character they begin with spares most places their alternatives.
FIRST = {
    "mentions_credential_path": "(?=[~.iIcC])", "mentions_shell_profile": "(?=[.])", "mentions_network_tool": "(?=[cCwWnNsSrR])", "mentions_encoding_and_transfer": "(?=[bBuUpPsS])",
    "instructs_the_reader_to_ignore_guidance": "(?=[iIdDwW])",
}
QUICK = {code: "{}(?:{})".format(*re.fullmatch(r"(\(\?\w+\))(.*)", p).groups()) for code, p in ADVISORIES}
QUICK["mentions_network_tool"] = r"(?i)\b(?:curl|wget|nc|scp|rsync)\b"

# Fixed value: a closing keyword bound to an issue number on the same line.
CLOSES = r"(?i)\b(?:clos(?:e|es|ed)|fix(?:e[sd])?|resolv(?:e|es|ed))\b[^\n#]{0,20}#(\d+)"


@pandas_udf(StringType())
def casefold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: t.casefold(), na_action="ignore")


@pandas_udf(StringType())
def nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def folded(text: Column) -> Column:
    """Case folding in generated code: lower case, and what folds further in texts that aren't ASCII."""
    lower = F.lower(text)
    whole = lower
    for letter, folds in FOLDS:
        whole = F.replace(whole, F.lit(letter), F.lit(folds))
    return F.when(F.octet_length(text) == F.char_length(text), lower).otherwise(whole)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(1))


#: Texts of these characters alone are cut by tables: Latin letters, whose classes no longer change; without those that folding makes several of, but for ß.
PLAIN, BUT = r"\A[\x00-\u024F]*\z", "İŉ"
#: Whether such a character is part of a token, and its lower case (that of ß is half of what it is folded to).
PLAIN_TOKEN = np.array([c == ord("_") or unicodedata.category(chr(c))[0] in "LN" for c in range(0x250)])
PLAIN_LOWER = np.array([ord("s") if c == ord("ß") else ord(chr(c).lower()[0]) for c in range(0x250)], "<u4")


def plain(text: Column) -> Column:
    return text.rlike(PLAIN) & ~text.contains(BUT[0]) & ~text.contains(BUT[1])


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def language(text: Column) -> Column:
    """'en', 'es' or null: at least two marker words and a lead of two."""
    lower = F.lower(text)
    plain = F.when(F.octet_length(text) == F.char_length(text), lower).otherwise(F.translate(lower, *ACCENTS))
    words = F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))
    # words and hits are bound by a lambda: each expression that names them would extract them anew
    hits = lambda w, marks: F.size(F.filter(w, lambda x: x.isin(*marks)))
    counts = F.transform(F.array(words), lambda w: F.struct(hits(w, ENGLISH).alias("en"), hits(w, SPANISH).alias("es")))

    def told(c: Column) -> Column:
        clear = (F.greatest(c["en"], c["es"]) >= LEAST_HITS) & (F.abs(c["en"] - c["es"]) >= LEAST_MARGIN)
        return F.when(clear, F.when(c["en"] > c["es"], "en").otherwise("es"))

    return F.element_at(F.transform(counts, told), 1)


def slug(text: Column, cap: int = 60) -> Column:
    dashed = F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, cap)
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def closes(body: Column) -> Column:
    """Issue numbers that a commit body closes, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(CLOSES), F.lit(1)), lambda n: n.cast("long")))


def digest(prefix: str, *parts: Column) -> Column:
    """A content-addressed id: SHA-256 of the parts joined by NUL."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\0", *parts), 256))


def advisories(text: Column) -> Column:
    """Codes of the patterns found, in their order."""
    return F.array_compact(F.array(*(F.when(text.rlike(FIRST[code] + p), F.lit(code)) for code, p in QUICK.items())))


def has_control(text: Column) -> Column:
    """Whether a control or format character other than tab, LF and CR occurs."""
    return text.rlike(r"[\p{Cc}\p{Cf}&&[^\t\n\r]]")


def newline_normalized(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def port(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[^:]*://(?:[^/?#@]*@)?[^/?#:]*:(\d{1,5})", 1), F.lit("")).cast("int"), F.lit(443))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


def canonical_url(url: Column) -> Column:
    """Scheme, host, port (443 unless stated), path and query; user data and fragment go."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    return F.concat(scheme, F.lit("://"), host(url), F.lit(":"), port(url).cast("string"), path(url), query)


def window_text(text: Column, start: Column, end: Column, item_cap: Column, remaining: Column) -> Column:
    """A 1-based inclusive range of code points under two caps: (valid, window, truncated)."""
    valid = (start >= 1) & (end >= start) & (start <= F.length(text))
    wanted = F.least(end, F.length(text)) - start + 1
    take = F.least(wanted, F.greatest(F.least(item_cap, remaining), F.lit(0)))
    return F.struct(valid.alias("valid"), F.when(valid, F.substring(text, start, take)).alias("window"), F.when(valid, take < wanted).alias("truncated"))


def excerpt(text: Column, permitted: Column, most: int, cap: int = 280) -> Column:
    return F.substring(text, F.lit(1), F.when(permitted, F.lit(most)).otherwise(F.lit(min(most, cap))))


def strip_build_sha(name: Column) -> Column:
    return F.regexp_replace(name, r"^(\d{4}-\d{2}-\d{2})-[0-9a-f]{8}-", "$1-")


def semver(version: Column) -> Column:
    """(major, minor, patch) as an array that compares in order; null unless three numbers."""
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.transform(F.split(version, r"\."), lambda x: x.cast("int")))


def extraction_method(mime: Column) -> Column:
    return (
        F.when(mime == "application/pdf", "pdf_text").when((mime == "application/json") | mime.endswith("+json"), "api_json")
        .when(mime == "text/html", "html_text").when(mime.startswith("text/"), "raw_lines").otherwise("unknown")
    )


def mime_allowed(mime: Column) -> Column:
    return F.coalesce(mime.startswith("text/") | mime.isin("application/pdf", "application/json") | mime.endswith("+json"), F.lit(False))
