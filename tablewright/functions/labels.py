"""Label expressions and column-name rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import rules
from tablewright.functions.columns import ladder


def period_label(date: Column, periods=rules.PERIODS, unknown: str = rules.UNKNOWN_PERIOD) -> Column:
    """Name of the first period whose end the date has not passed."""
    out = F.when(date.isNull(), F.lit(unknown))
    for name, end, closed in periods:
        if end is None:
            return out.otherwise(F.lit(name))
        edge = F.lit(end).cast("timestamp_ntz")
        out = out.when(date <= edge if closed else date < edge, F.lit(name))
    return out.otherwise(F.lit(unknown))


def quality_label(score: Column) -> Column:
    return ladder(score, rules.QUALITY_BANDS, rules.QUALITY_REST, rules.UNAVAILABLE)


def r2_label(score: Column) -> Column:
    return ladder(score, rules.R2_BANDS, rules.R2_REST, rules.UNAVAILABLE)


def size_band(rows: Column) -> Column:
    return ladder(rows, rules.SIZE_BANDS, rules.SIZE_REST)


def row_label(dims: Sequence[str], empty: str = "All selected records") -> Column:
    """"dim: value / dim: value", leaving out missing parts."""
    parts = [F.concat(F.lit(f"{d}: "), F.col(d).cast("string")) for d in dims]
    text = F.concat_ws(" / ", *parts)
    return F.when(text == "", F.lit(empty)).otherwise(text)


def says(name: str, kind: str) -> bool:
    """Whether the table of name rules gives a column this kind."""
    return any(re.search(pattern, name.lower()) for k, pattern in rules.NAME_RULES if k == kind)


def first_that(names: Sequence[str], kind: str) -> str | None:
    """The first column whose name says ``kind``."""
    return ([n for n in names if says(n, kind)] or [None])[0]


def find_date_col(names: Sequence[str]) -> str | None:
    """First column that is called like a date."""
    return first_that(names, "time")


def shared_words(a: str, b: str, shortest: int = 3) -> tuple[int, int]:
    """How many words of ``a`` there are, and how many of them ``b`` has too; short words do not count."""
    of_a, of_b = ({w for w in re.findall(r"[^-_]+", x.lower()) if len(w) >= shortest} for x in (a, b))
    return len(of_a), len(of_a & of_b)


def follows_target(name: str, target: str | None = None, spare: int = 1) -> bool:
    """A column that is derived by its name, or named after the target but for ``spare`` words."""
    words, common = shared_words(target, name) if target and target != name else (0, 0)
    return says(name, "derived") or (words > 0 and common >= max(1, words - spare))


def named_after(names: Sequence[str], groups: Sequence[Sequence[str]]) -> str | None:
    """The column that holds all words of a group; an earlier group beats an earlier column."""
    found = [(g, n) for g, words in enumerate(groups) for n, name in enumerate(names) if set(words) <= {w for w in words if w in name.lower()}]
    return names[min(found)[1]] if found else None


def date_name_score(name: str) -> int:
    return 45 * says(name, "calendar name") + 25 * says(name, "calendar word")


def target_name_score(name: str, template: str | None = None) -> int:
    low = name.lower()
    extra = rules.TEMPLATES[template][2] if template else []
    score = 30 * any(word in low for word in [*rules.TARGET_WORDS, *extra])
    return score + 35 * any(word in low for word in extra)


def can_be_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))


def project_title(source: str, fallback: str = "Untitled Data Project") -> str:
    """The last part of a source such as ``kind: folder/some-file.csv`` in words."""
    path = PurePosixPath(source.partition(":")[2].strip() or source)
    words = re.findall(r"[^-_\s]+", path.stem if path.suffix else path.name)
    return " ".join(words).title() or fallback
