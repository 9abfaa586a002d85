"""Column functions on text: keys, tokens, weights, previews, snippets and clean wiki markup."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words left out of queries.
STOPWORDS = ["a", "an", "the", "in", "on", "at", "of", "to", "for", "from", "by", "with", "as", "is", "are", "was", "were", "be", "been", "being"]
#: A letter or digit run, with at most one inner apostrophe part.
TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def join_key(column: Column | str) -> Column:
    """Key under which names are compared: underscores and white space as one space, trimmed, lower case."""
    spaced = F.regexp_replace(F.regexp_replace(column, "_", " "), BLANK, " ")
    return F.lower(F.trim(spaced))


def tokens(column: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))


#: Characters that compatibility composition keeps as they are, whatever stands beside them; there are others.
SETTLED = r"\x{00}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{386}\x{388}-\x{3CE}\x{400}-\x{481}\x{5D0}-\x{5EA}\x{621}-\x{64A}\x{2013}\x{2014}\x{2018}-\x{2023}\x{3001}-\x{3007}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility form of texts."""
    return values.str.normalize("NFKC")


def normal(column: Column | str) -> Column:
    """Compatibility form of a text. Only texts with a character beyond SETTLED are sent to Python; the others stay as they are."""
    c = F.col(column) if isinstance(column, str) else column
    other = c.rlike(rf"(?![\x{{00}}-\x{{9F}}])[^{SETTLED}]")  # one range first: most characters lie in it
    return F.coalesce(nfkc(F.when(other, c)), c)


def bpe_count(path: str):
    """A column function that counts the tokens of texts by the tokenizer of a JSON file, which each Python worker reads once."""
    @F.pandas_udf("int")
    def counts(values: pd.Series) -> pd.Series:
        tokenizer = _tokenizer(path)
        return values.map(lambda t: None if t is None else len(tokenizer.encode(t, add_special_tokens=False).ids))

    return counts


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def list_text(column: Column | str) -> Column:
    """A JSON list as its items between spaces; a JSON string as what it holds, and any other text as it stands."""
    c = F.col(column) if isinstance(column, str) else column
    items = F.array_join(F.from_json(c, "array<string>"), " ", "None")
    return F.when(c.rlike(r"^\s*\["), F.coalesce(items, c)).when(c.rlike(r'^\s*"'), F.coalesce(F.get_json_object(c, "$"), c)).otherwise(c)


def log_tf(tf: Column) -> Column:
    return F.when(tf > 0, 1 + F.ln(tf)).otherwise(0.0)


def idf(n: Column, df: Column, method: str = "classic") -> Column:
    """classic: ln(N / df), smooth: ln((N + 1) / (df + 1)) + 1; null outside 1..N."""
    ok = (df >= 1) & (df <= n)
    return F.when(ok, F.ln(n / df) if method == "classic" else F.ln((n + 1) / (df + 1)) + 1)


def collapsed(column: Column | str) -> Column:
    return F.trim(F.regexp_replace(column, BLANK, " "))


def preview(column: Column | str, size: int = 320) -> Column:
    return F.substring(collapsed(column), 1, size)


def preview_dots(column: Column | str, size: int = 500) -> Column:
    text = collapsed(column)
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size)), F.lit("..."))).otherwise(text)


def word_count(column: Column | str) -> Column:
    return F.size(F.filter(F.split(column, BLANK), lambda x: x != ""))


def document_id(url: Column | str) -> Column:
    return F.substring(F.sha2(url, 256), 1, 24)


def snippet(column: Column | str, terms: Column, width: int = 260) -> Column:
    """`width` characters of the collapsed text from a third of them before the first whole-word hit, with ellipses where cut.

    A word ends where no letter, digit or underscore follows; case counts for nothing.
    """
    text = collapsed(column)
    place = lambda t: F.regexp_instr(text, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), t, F.lit(r"\E(?![\p{L}\p{N}_])")))
    hits = F.array_min(F.filter(F.transform(terms, place), lambda p: p > 0))
    start = F.greatest(F.coalesce(hits, F.lit(1)) - width // 3, F.lit(1))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, F.lit(width)), F.when(start + width <= F.length(text), "…").otherwise(""))


def highlight(column: Column | str, terms: list[str], before: str = "**", after: str = "**") -> Column:
    """Whole-word hits of terms between markers, whatever their case."""
    import re

    if not terms:
        return F.col(column) if isinstance(column, str) else column
    pattern = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    return F.regexp_replace(column, pattern, before + "$1" + after)


# Steps that turn wiki markup into plain text, in their order.
WIKITEXT = [
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<ref\b[^>]*>.*?</ref\s*>|<ref\b[^>]*/\s*>", " "),
    (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"(?s)\{\{.*?\}\}", " "),
    (r"'{2,5}", ""),
    (r"<[^>]+>", " "),
]


def clean_wikitext(column: Column | str) -> Column:
    out = F.col(column) if isinstance(column, str) else column
    for pattern, by in WIKITEXT:
        out = F.regexp_replace(out, pattern, by)
    return collapsed(out)
