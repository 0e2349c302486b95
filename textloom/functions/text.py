"""Column expressions on text. All stay in the JVM except :func:`nfkc`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The public pre-tokenizer patterns, in Java syntax.
PAT_STRIP = r"(?U)^\s+|\s+$"
PAT_SPACED = r"(?U)\S+"
PAT_WORD = r"(?U)\w+|[^\w\s]+"
PAT_BYTE = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NOT_FOUND_TEXT = "404: Not Found"
MIN_CHARS = 10


def strip(text: Column) -> Column:
    """Remove white space at both ends, Unicode spaces included."""
    return F.regexp_replace(text, PAT_STRIP, "")


def universal_newlines(text: Column) -> Column:
    """Turn ``\\r\\n`` and ``\\r`` into ``\\n``."""
    return F.regexp_replace(text, "\r\n?", "\n")


def utf8_lossy(content: Column) -> Column:
    """Decode bytes, dropping what is not valid UTF-8."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def n_lines(text: Column) -> Column:
    """Pieces between newlines; one more than the number of newlines."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PAT_SPACED)).cast("bigint")


def first_lines(text: Column, limit: int) -> Column:
    """The first ``limit`` lines, each with its newline, as one string."""
    kept = F.substring_index(text, "\n", limit)
    return F.when(F.length(kept) < F.length(text), F.concat(kept, F.lit("\n"))).otherwise(text)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def reject_reason(text: Column) -> Column:
    """Why a document is unusable: ``blank``, ``not_found``, ``short``; null when it is fine."""
    stripped = strip(text)
    return (
        F.when(text.isNull(), "unreadable")
        .when(stripped == "", "blank")
        .when(stripped == NOT_FOUND_TEXT, "not_found")
        .when(F.length(text) < MIN_CHARS, "short")
    )


def clip(text: Column, chars: int) -> Column:
    """One-line report form: newlines shown as ``\\n``, then cut."""
    return F.substring(F.replace(text, F.lit("\n"), F.lit("\\n")), 1, chars)


def after_prompt(full: Column, prompt: Column) -> Column:
    """What follows the prompt in a completed text."""
    return F.substring(full, F.length(prompt) + 1, F.length(full))


def first_block(text: Column) -> Column:
    """Everything before the first blank line."""
    return F.split_part(text, F.lit("\n\n"), F.lit(1))


def step_of_name(name: Column) -> Column:
    """Step written in an artifact name: 999999 without ``step_``, 0 when it is no number."""
    last = F.element_at(F.split(name, "step_"), -1)
    return F.when(~name.contains("step_"), 999999).otherwise(
        F.coalesce(F.trim(last).try_cast("int"), F.lit(0))
    )


@F.pandas_udf(StringType())
def _nfkc_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Plain ASCII text is its own normal form and is not handed to Python."""
    return F.coalesce(_nfkc_udf(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)), text)


def _byte_tables() -> tuple[str, str]:
    """Bytes without a printable Latin-1 character, and the characters that stand for them."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return "".join(map(chr, hidden)), "".join(chr(256 + i) for i in range(len(hidden)))


HIDDEN_BYTES, HIDDEN_SIGNS = _byte_tables()


def bytes_to_signs(word: Column) -> Column:
    """Each UTF-8 byte as one printable character (a space becomes U+0120)."""
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, HIDDEN_BYTES, HIDDEN_SIGNS)


def signs_to_text(signs: Column) -> Column:
    """Inverse of :func:`bytes_to_signs`; broken byte sequences become U+FFFD."""
    # translate cannot produce the character of byte 0, so that one is replaced
    latin = F.replace(
        F.translate(signs, HIDDEN_SIGNS[1:], HIDDEN_BYTES[1:]), F.lit(HIDDEN_SIGNS[0]), F.lit(HIDDEN_BYTES[0])
    )
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


def words_of(text: Column) -> Column:
    """Whitespace pre-tokens: runs of word characters and runs of other signs."""
    return F.regexp_extract_all(text, F.lit(PAT_WORD), F.lit(0))


def byte_words_of(text: Column) -> Column:
    """Byte-level pre-tokens as raw text, without a prefix space."""
    return F.regexp_extract_all(text, F.lit(PAT_BYTE), F.lit(0))


def pretokens(text: Column, scheme: str) -> Column:
    """Pre-tokens of scheme ``word`` or ``byte`` (raw text)."""
    if scheme == "word":
        return words_of(text)
    if scheme == "byte":
        return byte_words_of(text)
    raise ValueError(f"unknown pre-token scheme {scheme!r}")
