"""Text functions: white space, cleaning, tokens. Columns in, columns out."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: All white space of Unicode, spelled out: the JVM's \s knows less.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@arrow_udf(StringType())
def ascii_fold(text: pa.Array) -> pa.Array:
    """Letters decomposed (NFKD), everything outside ASCII dropped."""
    return pc.replace_substring_regex(pc.utf8_normalize(text, form="NFKD"), r"[^\x00-\x7F]", "")


def norm_whitespace(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def clean_text(text: Column, to_lower: bool = True, norm_num: bool = True) -> Column:
    """ASCII words of letters, digits and hyphens with one space between; links go, digits become 1. A missing text counts as an empty one."""
    clean = F.regexp_replace(ascii_fold(F.coalesce(text, F.lit(""))), f"https?://[^{SPACE}]*", " ")
    if to_lower:
        clean = F.lower(clean)
    if norm_num:
        clean = F.regexp_replace(clean, "[0-9]", "1")
    return F.trim(F.regexp_replace(clean, "[^A-Za-z0-9-]+", " "))


def tokens(clean: Column) -> Column:
    """The words of a cleaned text."""
    return F.filter(F.split(clean, " "), lambda x: x != "")
