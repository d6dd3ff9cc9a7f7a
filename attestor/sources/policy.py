"""Corpus policies: which files of a folder belong to the corpus."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Folders that never belong to a corpus.
DENIED = ("archive", "config", "generated", "personal", "diary", "sensitive")


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Policy:
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Policy:
        """A YAML file with ``version: 1`` and lists of patterns."""
        try:
            import yaml  # only this loader needs it
        except ImportError as error:
            raise PolicyError("yaml_unavailable") from error
        text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())  # one small file
        data = yaml.safe_load(text)
        if not isinstance(data, dict) or data.get("version") != 1:
            raise PolicyError("unsupported_policy")
        lists = [data.get(k) or [] for k in ("include", "exclude")]
        if not all(isinstance(x, str) for items in lists for x in items):
            raise PolicyError("invalid_policy_pattern")
        return cls(*map(tuple, lists))

    def reason(self, path: Column) -> Column:
        """Why a relative path isn't in the corpus; null if it is."""
        parts = F.split(path, "/")
        outside = path.startswith("/") | F.exists(parts, lambda p: p == "..")
        hidden = F.exists(parts, lambda p: p.startswith(".") | F.lower(p).isin(*DENIED))
        return F.when(outside, "outside_approved_root").when(hidden | _any(path, self.exclude), "excluded_by_policy").when(~_any(path, self.include), "not_allowlisted")

    def discover(self, files: DataFrame, path: str = "path") -> DataFrame:
        """The markdown files of ``files`` that belong to the corpus."""
        return files.where(F.col(path).endswith(".md") & self.reason(F.col(path)).isNull())


def _any(path: Column, patterns: tuple[str, ...]) -> Column:
    # a shell pattern's translation, anchored at both ends, in the form that Java reads
    found = [path.rlike("^(?s)" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + r"\z") for p in patterns]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out
