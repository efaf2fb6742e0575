"""Text as column expressions: tokens, wiki and HTML clean-up, reply clean-up."""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK_RUN = "[一-鿿]+"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"
INDEXED, CJK_RUNS, PLAIN = re.compile("[a-z0-9]+"), re.compile(CJK_RUN), str.maketrans(ACCENTED, UNACCENTED)

# --- fixed values: markup taken out of wiki text, in this order ----------------------------------
WIKI_MARKUP: tuple[tuple[str, str], ...] = (
    (r"<ref[^>]*/>", ""),
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"\{\{[Ii]nfobox[^{}]*\}\}", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
    (r"'''?", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"</?[a-zA-Z][^>]*>", ""),
    (r"\[\d+\]", ""),
    (r"[ \t]+", " "),
)
#: Every other entry needs one of these.
ANY_MARK = r"[<\[]|\{\{|''"
SECTION_HEAD = r"\n(={2,5})\s*([^=\n]+?)\s*\1\n"
SENTENCE_END = r"[。！？!?\.]+[\s\n]|[\n]+"
SENTENCE_LENGTHS = (12, 400)

# --- fixed values: page elements that are not part of the visible text, and character entities ---
HIDDEN_ELEMENTS = ("script", "style", "nav", "footer")
ENTITIES: tuple[tuple[str, str], ...] = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
)


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def cjk_grams(text: Column) -> Column:
    """Runs of CJK characters as pairs of neighbours; a run of one or two stays whole."""
    runs = F.regexp_extract_all(text, F.lit(f"({CJK_RUN})"))
    return F.flatten(F.transform(runs, lambda run: F.when(F.length(run) <= 2, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))))


def query_tokens(text: Column, limit: int | None = 12) -> Column:
    """Tokens of a query: Latin and digit runs in lower case, then CJK pairs, at most ``limit``; ``None`` is all."""
    latin = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)")), lambda t: F.lower(t))
    tokens = F.concat(latin, cjk_grams(text))
    return tokens if limit is None else F.slice(tokens, 1, limit)


def index_tokens(text: Column) -> Column:
    """Tokens of an indexed text: words without accents in lower case, then CJK pairs."""
    plain = F.translate(F.lower(text), ACCENTED, UNACCENTED)
    return F.concat(F.regexp_extract_all(plain, F.lit("([a-z0-9]+)")), cjk_grams(text))


def count_tokens(text: str | None) -> Counter[str]:
    """``index_tokens`` in Python, each different one once, with how often it occurs."""
    text = (text or "").lower()
    if text.isascii():
        return Counter(INDEXED.findall(text))
    text = text.translate(PLAIN)
    found = Counter(INDEXED.findall(text))
    for run in CJK_RUNS.findall(text):
        found.update([run] if len(run) <= 2 else map("".join, pairwise(run)))
    return found


def strip_wiki_markup(text: Column) -> Column:
    """Plain text of wiki text. Where nothing stands that any other mark needs, only blanks are folded."""
    stripped = text
    for pattern, value in WIKI_MARKUP:
        stripped = F.regexp_replace(stripped, pattern, value)
    return strip(F.when(text.rlike(ANY_MARK), stripped).otherwise(F.regexp_replace(text, *WIKI_MARKUP[-1])))


def visible_text(html: Column, limit: int | None = None) -> Column:
    """Text a reader sees: hidden elements and tags out, one line per piece."""
    for element in HIDDEN_ELEMENTS:
        html = F.regexp_replace(html, rf"(?is)<{element}\b[^>]*>.*?</{element}\s*>", "")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, r"(?s)<[^>]*>", "\n")
    for entity, character in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(character))
    text = strip(F.regexp_replace(html, r"\s*\n\s*", "\n"))
    return text if limit is None else F.substring(text, 1, limit)


def reply_body(raw: Column) -> Column:
    """A model reply without thinking blocks and code fences."""
    open_tag, close_tag = "<think>", "</think>"
    text = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    after = F.substring(text, F.locate(open_tag, text) + len(open_tag), F.length(text))
    closed = F.substring(after, F.locate(close_tag, after) + len(close_tag), F.length(after))
    after = F.when(F.locate(close_tag, after) > 0, closed).otherwise(after)
    text = F.when(F.locate(open_tag, text) > 0, after).otherwise(text)
    inner = F.regexp_replace(F.regexp_replace(text, "^`+|`+$", ""), r"^(json|JSON)[^\n]*\n?", "")
    return strip(F.when(F.startswith(text, F.lit("```")), inner).otherwise(text))
