"""Text normalisation as column expressions that agree with Unicode-aware string methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode string methods see it (a Java ``\s`` is ASCII only).
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: The same as characters.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.btrim(x, F.lit(BLANKS))


def normalize_text(x: Column) -> Column:
    """Line ends to line feeds, runs of blanks and tabs to one blank, at most one empty line in a row, stripped."""
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def normalize_evidence(x: Column) -> Column:
    """Lower case, white space to single blanks, stripped, curly double quotes and the closing single quote to straight ones."""
    x = strip(F.regexp_replace(F.lower(x), f"{SPACE}+", " "))
    return F.replace(F.regexp_replace(x, "[“”]", '"'), F.lit("’"), F.lit("'"))


def strip_tags(x: Column) -> Column:
    """Without anything between angle brackets, line feeds included."""
    return F.regexp_replace(x, r"<[^>]+>", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def prompt(chunk: Column, system: str | Column = "") -> Column:
    """A chunk framed for a model that takes plain text."""
    head = system if isinstance(system, Column) else F.lit(system)
    return F.concat(head, F.lit("\n\n【输入文本】:\n"), chunk, F.lit("\n\n【输出 JSON List】:"))


def chat_prompt(chunk: Column, system: str) -> Column:
    """A chunk framed as chat messages: array of role and content."""
    user = F.concat(F.lit("【输入文本】\n"), chunk, F.lit("\n"))
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", user))])
