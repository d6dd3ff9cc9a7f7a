"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Base spans (fixed by the contract) are found in whole texts: leftmost, non-overlapping, without a second try for one
   that fails its check. They are always reported.
2. Wider patterns propose further candidates of every kind: mail addresses whose "@" and "." are spelled out; addresses of hosts with bracketed or
   spelled-out dots, and those of version 6; groups of 4-4-4-4, 4-6-5, 4-6-4 or 13 to 19 unbroken digits that pass Luhn's check, also inside a longer run
   of digits (groups only near a word of payment) or with dots or slashes (they may overlap one another); numbers of telephone length without a leading plus.
3. Five labelers vote for, against or abstain on every candidate, and none of them knows whether it is a base span: two *regex* labelers (the span's
   form; what touches it), a *gazetteer* (top-level domains, reserved and version-like addresses, card issuers with their lengths, country codes) and two
   *context* labelers (telling words within ``CONTEXT`` code points; words that speak against it).
4. The votes are aggregated to a table of vote patterns per kind (3 ** labelers rows at most), and expectation-maximisation on the driver estimates
   each labeler's reliability and each pattern's probability of being personal data.
5. A logistic regression on votes and shape, each with a weight of its own per kind, trained on at most ``TRAINING`` candidates with those
   probabilities as labels, is the final span classifier. Candidates over ``ACCEPT`` that don't touch a base span of their kind are added.

A document is one row throughout: candidates travel as an array, so nothing is joined or shuffled but the pattern counts.

Defined cases: null text is empty; repeated rows and null ids are kept row by row; an empty table gives an empty result; texts of any
length are scanned whole in linear time (times a logarithm); input columns named like an output column are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestor import scratch

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40
TRAINING = 20_000
ACCEPT = 0.9
EM_ROUNDS = 50
OWN = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
CANDIDATE = "array<struct<kind:int,start:int,stop:int,base:boolean,votes:array<int>,shape:array<float>>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can't begin inside a run of digits, as it would also begin at the run's start. That is looked at behind the first digit, as
#: a pattern that begins with a set is searched for much faster.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_DOT = r"(?: ?[\[({](?:dot|\.)[\])}] ?| dot )"
#: Runs are matched from their start only, so that a long one isn't gone through once per character.
_WIDE = {
    0: re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({{](?:at|@)[\])}}] ?| at )[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+"),
    1: re.compile(rf"(?<![0-9])[0-9]++(?:{_DOT}[0-9]++){{3}}|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{{1,4}}:){{1,7}}(?::?[0-9A-Fa-f]{{1,4}}){{0,7}}(?![0-9A-Za-z:])"),
    2: re.compile(r"[0-9](?<![0-9][0-9])(?=((?:[0-9]{3}[ ./-](?:[0-9]{4}[ ./-]){2}[0-9]{4}|[0-9]{3}[ ./-][0-9]{6}[ ./-][0-9]{4,5}|[0-9]{12,18})(?![0-9])))"),
    3: re.compile(
        r"(?s)[0-9(](?<![0-9+].)(?:(?<=\()[0-9]{2,4}\) ?|(?<=0)[0-9]{1,4}[ ./-]|(?<=[0-9])[0-9]{2}[ .-](?=[0-9]{3}[ .-][0-9]{4}(?![0-9])))"
        r"[0-9]{2,8}(?:[ .-][0-9]{2,5}){0,4}(?![0-9])"
    ),
}
_WORDS = {
    0: re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|correo|courriel)\b"),
    1: re.compile(r"(?i)\b(?:ip|host|server|address|login|from|adresse|direcci)"),
    2: re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)"),
    3: re.compile(r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|appel|llam)"),
}
_AGAINST = re.compile(r"(?i)\b(?:isbn|issn|version|release|order|invoice|serial|part|item|section|chapter|figure|table|id|no|nr|ref|page)\b\W*$")
_MAIL = re.compile(r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|example|test)$")
_FORM = {
    0: re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9%+-]|[._](?=[A-Za-z0-9%+-])){0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    1: re.compile(r"(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})|.*:.*"),
    2: re.compile(r"(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4})|[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{4,5}|[0-9]{4}([./])[0-9]{4}\3[0-9]{4}\3[0-9]{4}|[0-9]{13,19}"),
    3: re.compile(r"\+?[0-9]{0,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{2,12}(?:[ .-][0-9]{2,8}){0,5}"),
}
#: Issuers' prefixes with the numbers of digits their cards have.
_ISSUERS = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14}|3(?:0|6|8)[0-9]{12}")
_COUNTRIES = re.compile(r"^\+?(?:1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])")
_JOINT = re.compile(r"[A-Za-z0-9_]|[-./@:][A-Za-z0-9]")
LABELERS = ("form", "edges", "gazetteer", "context", "against")
#: How much more likely a labeler's vote is at least where it's right than where it's wrong: what EM may not unlearn when most labelers agree by chance.
LEAST = (1.5, 1.5, 1.5, 2.0, 50.0)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) in order."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _plain(kind: int, span: str) -> str:
    """A mail or host address with what is spelled out put as signs."""
    if kind > 1 or ":" in span:
        return span
    return re.sub(r"\s*[\[({]?(?:at|@)[\])}]\s*| at ", "@", re.sub(_DOT, ".", span)) if kind == 0 else re.sub(_DOT, ".", span)


def _host(span: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address, leading zeros dropped; None if it isn't one."""
    try:
        return ipaddress.ip_address(span if ":" in span else ".".join(p.lstrip("0")[:4] or "0" for p in span.split(".")))
    except ValueError:
        return None


def _gazetteer(kind: int, plain: str, digits: str) -> int:
    if kind == 0:
        return 1 if _MAIL.search(plain[-12:]) else 0
    if kind == 1:
        address = _host(plain)
        if address is None or address.is_unspecified or address.is_loopback or address.is_multicast:
            return -1
        if address.version == 4 and max(address.packed) < 20:  # four small numbers: more like a version
            return -1
        return 1 if address.is_global or address.is_private else 0
    if kind == 2:
        return 1 if _ISSUERS.fullmatch(digits) else -1
    return 1 if plain[0] in "+(0" and _COUNTRIES.match(digits.lstrip("0")) else 0


def _inside(before: str, after: str) -> bool:
    """Whether a number goes on before or after."""
    return bool(re.match(r"[ ./-]?[0-9]", after) or re.search(r"[0-9][ ./-]?$", before))


def _payment(before: str, after: str) -> bool:
    return bool(_WORDS[2].search(before) or _WORDS[2].search(after))


def _vote(kind: int, span: str, before: str, after: str) -> tuple[list[int], list[float]]:
    """The LABELERS' votes (1 for, -1 against, 0 abstains), and the span's shape."""
    plain, digits = _plain(kind, span), _digits(span)
    form = 1 if len(span) <= 320 and _FORM[kind].fullmatch(plain) else -1
    apart = "(" if kind == 3 else ""  # what may stand before a telephone number
    edges = -1 if _JOINT.match(after) or _JOINT.match(before[::-1].lstrip(apart)) or kind > 1 and _inside(before, after) else 1
    context = 1 if _WORDS[kind].search(before) or kind == 2 and _payment(before, after) else 0
    against = -1 if _AGAINST.search(before) else 0
    shape = [min(len(span), 320) / 32, min(len(digits), 32) / 16, min(span.count(" "), 8) / 4, float(span[:1].isdigit())]
    return [form, edges, _gazetteer(kind, plain, digits), context, against], shape


def _around(text: str, start: int, stop: int) -> tuple[str, str]:
    return text[max(0, start - CONTEXT) : start], text[stop : stop + CONTEXT]


def _possible(text: str, kind: int) -> bool:
    """Whether a wide pattern can match at all: cheap tests that spare most texts a scan."""
    if kind == 0:
        return any(x in text for x in ("at]", "at)", "at}", "@]", "@)", "@}")) or " at " in text and " dot " in text
    if kind == 1:
        return any(x in text for x in ("[.", "(.", "{.", "dot]", "dot)", "dot}", " dot ", "::")) or text.count(":") > 6
    return True


def _proper(kind: int, span: str) -> bool:
    if kind == 1:
        return (span.count(":") in (0, 7) or "::" in span) and _host(_plain(1, span)) is not None
    if kind == 2:
        return luhn(_digits(span))
    return kind == 0 or 9 <= len(_digits(span)) <= 15


def candidates(text: str) -> list[tuple]:
    """(kind, start, stop, base, votes, shape) in order."""
    base = base_spans(text)
    found = [(*s, True) for s in base]
    # spans of a kind are in order and don't overlap, so one search tells whether any of them touches a candidate
    starts, stops = ([[s[i] for s in base if s[1] == k] for k in range(len(KINDS))] for i in (0, 2))
    for kind, pattern in _WIDE.items():
        if not _possible(text, kind):
            continue
        own = [(a, b) for k, (a, b) in enumerate(zip(starts, stops, strict=True)) if a and (k == kind or kind == 3)]
        for m in pattern.finditer(text):
            start, stop = m.start(), m.end(pattern.groups)
            if any((i := bisect.bisect_left(a, stop)) and b[i - 1] > start for a, b in own):
                continue
            span = text[start:stop]
            if not _proper(kind, span):
                continue
            # groups cut out of a longer row of groups are a guess unless something speaks of payment
            if kind == 2 and not span.isdigit() and _inside(*(around := _around(text, start, stop))) and not _payment(*around):
                continue
            found.append((start, kind, stop, False))
    out = []
    for start, kind, stop, is_base in sorted(found):
        votes, shape = _vote(kind, text[start:stop], *_around(text, start, stop))
        out.append((kind, start, stop, is_base, votes, shape))
    return out


def em(patterns: dict[tuple, int], rounds: int = EM_ROUNDS) -> dict[tuple, float]:
    """Probability that a vote pattern is positive: labelers independent given the class, each better than chance by LEAST."""
    if not patterns:
        return {}
    rows = list(patterns)
    votes, n = np.array([r[1:] for r in rows]), np.array([patterns[r] for r in rows], float)
    p = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
        up, down = np.full(len(rows), math.log(prior)), np.full(len(rows), math.log(1 - prior))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                here = votes[:, j] == v
                lean = 2.0 * v
                yes = ((n * p)[here].sum() + 1 + max(lean, 0)) / ((n * p).sum() + 5)
                no = ((n * (1 - p))[here].sum() + 1 + max(-lean, 0)) / ((n * (1 - p)).sum() + 5)
                if v:  # no labeler may be learned to be worse than its bound
                    yes, no = (yes, min(no, yes / LEAST[j])) if v > 0 else (min(yes, no / LEAST[j]), no)
                up[here] += math.log(yes)
                down[here] += math.log(no)
        p = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
    return dict(zip(rows, p, strict=True))


def reliabilities(patterns: dict[tuple, int], probable: dict[tuple, float]) -> list[float]:
    """Per labeler the share of its votes that agree with the probabilities; 0.5 without votes."""
    out = []
    for j in range(len(LABELERS)):
        votes = [(r[1 + j], n, probable[r]) for r, n in patterns.items() if r[1 + j]]
        out.append((sum(n * (p if v > 0 else 1 - p) for v, n, p in votes) + 0.5) / (sum(n for _, n, _ in votes) + 1))
    return out


SHAPE = 4
FEATURES = 1 + len(LABELERS) + SHAPE


def features(kind: int, votes: list[int], shape: list[float]) -> np.ndarray:
    x = np.zeros((len(KINDS), FEATURES))
    x[kind] = [1, *votes, *shape]
    return x.ravel()


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression on soft labels by Newton's steps; the ridge keeps features without data at zero."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
    return w


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``found``, their candidates; the text and columns named like an output column go."""
    taken = {*OWN, "found", text.lower()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in taken]

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[dict(zip(("kind", "start", "stop", "base", "votes", "shape"), c, strict=True)) for c in candidates(t or "")] for t in pdf.pop("__text")]
            pdf["found"] = found
            yield pdf

    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("found", T._parse_datatype_string(CANDIDATE))])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").cast("string").alias("__text")).mapInPandas(work, schema)


def train(found: DataFrame) -> np.ndarray | None:
    """The classifier's weights from a written table of candidates."""
    spans = found.select(F.explode("found").alias("c")).select("c.*")
    counts = spans.groupBy("kind", *(F.col("votes")[i].alias(f"v{i}") for i in range(len(LABELERS)))).count().collect()  # 4 * 3 ** 5 rows at most
    probable = {}
    for kind in range(len(KINDS)):
        probable |= em({tuple(r[:-1]): r[-1] for r in counts if r[0] == kind})
    if not probable:
        return None
    some = spans.orderBy(F.xxhash64("kind", "start", "stop", "votes"), "kind", "start", "stop").limit(TRAINING).select("kind", "votes", "shape").toPandas()
    x = np.array([features(*r) for r in some.itertuples(index=False)])
    y = np.array([probable[(r.kind, *r.votes)] for r in some.itertuples(index=False)])
    return fit(x, y)


def score(kind: int, votes: list[int], shape: list[float], w: np.ndarray) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(kind, votes, shape) @ w)))))


def accepted(found: list, w: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(start, kind, stop, base) of base spans and of accepted ones."""
    out = []
    for c in found:
        if c["base"] or score(c["kind"], c["votes"], c["shape"], w) >= ACCEPT:
            out.append((c["start"], c["kind"], c["stop"], c["base"]))
    return sorted(out)


def _text(spans: Iterable[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with OWN."""
    with scratch.small_batches(docs.sparkSession):
        found = scratch.cut(scan(docs, text), "pii-candidates")
    w = train(found)
    weights = np.zeros(len(KINDS) * FEATURES) if w is None else w
    from pyspark.sql import types as T

    kept = [f for f in found.schema.fields if f.name != "found"]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in OWN[:4]), *(T.StructField(c, T.StringType()) for c in OWN[4:])])

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [accepted(f, weights) for f in pdf.pop("found")]
            base = [[s for s in r if s[3]] for r in rows]
            for k, c in enumerate(OWN[:4]):
                pdf[c] = np.array([sum(s[1] == k for s in r) for r in base], "int64")
            pdf["base_sha256"] = [hashlib.sha256(_text(r).encode()).hexdigest() for r in base]
            pdf["spans"] = [_text(r) for r in rows]
            yield pdf

    return found.mapInPandas(work, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals between angle brackets; overlapping spans become one."""
    with scratch.small_batches(docs.sparkSession):
        w = train(scratch.cut(scan(docs.select(F.col(f"`{text}`").alias("text"))), "pii-candidates"))
    weights = np.zeros(len(KINDS) * FEATURES) if w is None else w

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        found = [dict(zip(("kind", "start", "stop", "base", "votes", "shape"), c, strict=True)) for c in candidates(t)]
        out, at = [], 0
        for start, kind, stop, _ in accepted(found, weights):
            if start >= at:
                out += [t[at:start], f"<{KINDS[kind].upper()}>"]
            at = max(at, stop)
        return "".join([*out, t[at:]])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = pa.array([clean(t.as_py()) for t in batch.column(at)], batch.column(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(work, docs.schema)
