"""Fill-in-middle transformation: texts cut at two places into prefix, middle and suffix, put together anew for training.

An Arrow-batched pandas UDF does the work of a row by itself, so nothing is shuffled: ``finditer`` of the regex library gives the end of each
unit, the ends go into an array of four bytes each, two look-ups in it slice the text, and hashlib computes the seeds and the digest. The seeds
depend on the key alone, so a task that runs again, or another order of rows, gives the same rows.

A unit is a code point by default; ``unit`` may be any pattern that can't match nothing (words, lines, bytes of a code). What lies between two units
goes with the latter, what follows the last with the suffix.

Defined cases: null text is empty, and empty texts stay plain, as do texts that hold a sentinel; a null key is seeded as an empty one; repeated rows
and ties give equal results; an empty table gives an empty result; input columns named like an output column are replaced by it. Texts are whole
whatever their length: besides text and result, a text of n units takes 4 n bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
#: Of a hundred texts, how many are transformed, and of these how many with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
OWN = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def seeds(salt: str, key: str | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a key."""
    digest = hashlib.sha256(f"{salt}:{key or ''}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def _ends(units: regex.Pattern, text: str) -> array:
    return array("I", (m.end() for m in units.finditer(text)))


def transform(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", unit: str = CODE_POINT, salt: str = "1", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``docs`` with OWN: units, form (plain, psm, spm), code points of prefix and middle (null if plain), the text to train on and its SHA-256."""
    if regex.compile(unit).fullmatch(""):
        raise ValueError("a unit can't be empty")

    @F.pandas_udf(_RESULT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units = regex.compile(unit)
        for keys, texts in batches:
            rows = []
            for k, whole in zip(keys, texts, strict=True):
                whole = whole if isinstance(whole, str) else ""
                ends, (h1, h2, h3, h4) = _ends(units, whole), seeds(salt, k if isinstance(k, str) else None)
                n = len(ends)
                form, prefix, middle, out = "plain", None, None, whole
                if whole and h3 % 100 < transformed and not any(s in whole for s in (PREFIX, SUFFIX, MIDDLE)):
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    i, j = ends[a - 1] if a else 0, ends[b - 1] if b else 0
                    form, prefix, middle = "spm" if h4 % 100 < suffix_first else "psm", i, j - i
                    first, second = f"{PREFIX}{whole[:i]}", f"{SUFFIX}{whole[j:]}"
                    out = f"{second}{first}{MIDDLE}{whole[i:j]}" if form == "spm" else f"{first}{second}{MIDDLE}{whole[i:j]}"
                rows.append((n, form, prefix, middle, out, hashlib.sha256(out.encode()).hexdigest()))
            frame = pd.DataFrame(rows, columns=list(OWN))
            yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    kept = [f"`{c}`" for c in docs.columns if c.lower() not in OWN]
    held = "__infill" + "_" * max(map(len, docs.columns))  # no name of the input
    # as text, so that a null doesn't make floats of whole numbers
    made = docs.select(*kept, cut(F.col(key).cast("string"), F.col(text).cast("string")).alias(held))
    return made.select(*kept, f"{held}.*")


@F.pandas_udf(T.StringType())
def restored(forms: pd.Series, outputs: pd.Series) -> pd.Series:
    """The text that a form and an output of ``transform`` stand for: sentinels can't occur in its parts, nor across their borders."""

    def one(form: str, out: str) -> str:
        if form == "plain":
            return out
        head, _, middle = out.partition(MIDDLE)
        if form == "psm":
            prefix, _, suffix = head.removeprefix(PREFIX).partition(SUFFIX)
        else:
            suffix, _, prefix = head.removeprefix(SUFFIX).partition(PREFIX)
        return prefix + middle + suffix

    return pd.Series([one(f, o) for f, o in zip(forms, outputs, strict=True)], dtype=object)

