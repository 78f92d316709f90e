"""Text expressions: tokens, chunks, prompts, answers, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern, and the words that searches leave out.
TOKEN = r"[\p{L}\p{N}_]{2,}"
STOPWORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more letters, digits or underscores, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def terms(text: Column) -> Column:
    """The tokens that are no stop words, repeats kept."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS))


def prefixed(text: Column, kind: str) -> Column:
    """The form in which encoders take queries and passages."""
    return F.concat(F.lit(f"{kind}: "), text)


def check_chunking(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"chunk size {size} and overlap {overlap}: need 0 <= overlap < size")


def fixed_chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Slices of ``size`` characters that begin every ``size - overlap``; an empty text is one
    empty chunk, and the last chunk may be overlap only."""
    step = max(1, size - overlap)
    body = F.coalesce(text, F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(body) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.substr(body, i + 1, F.lit(size)))


def n_fixed_chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    step = max(1, size - overlap)
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(step))).cast("int")


def contains_answer(answer: Column, golds: Column) -> Column:
    """Whether any non-empty gold answer occurs in ``answer``, regardless of case."""
    low = F.lower(answer)
    return F.coalesce(F.exists(golds, lambda g: (F.length(g) > 0) & F.contains(low, F.lower(g))), F.lit(False))


def squeeze(text: Column) -> Column:
    """Lower case with single spaces: the part of answer normalisation SQL can express."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def aliases(raw: Column) -> Column:
    """A JSON list of answers, or one plain answer: trimmed, without blanks and repeats."""
    listed = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    values = F.when(F.ltrim(raw).startswith("["), F.coalesce(listed, F.array(raw))).otherwise(F.array(raw))
    return F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.transform(values, F.trim), lambda v: v.isNotNull() & (v != ""))))


def clean_id(value: Column) -> Column:
    """Ids that went through floats and strings: trimmed, without a final ``.0``."""
    return F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")


def prompt(question: Column, documents: Column, dataset: Column, n: int, template: str, separator: str = "\n\n") -> Column:
    """``template`` with {question}, {documents} (the first n) and {dataset} filled in."""
    import string

    unknown = {f for _, f, _, _ in string.Formatter().parse(template) if f is not None} - {"question", "documents", "dataset"}
    if unknown:
        raise ValueError(f"unknown placeholders: {', '.join(sorted(unknown))}")
    out: Column = F.lit(template)
    joined = F.array_join(F.slice(documents, 1, n), separator)
    for name, value in (("dataset", dataset), ("documents", joined), ("question", question)):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def verdict(answer: Column) -> Column:
    """The boolean ``verdict`` of a judge: the JSON itself, else the first object inside the
    text, else the field by pattern; null when none can be read."""
    kind = "struct<verdict:boolean,reasoning:string>"
    strict = F.from_json(F.trim(answer), kind)["verdict"]
    inner = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), kind)["verdict"]
    field = F.regexp_extract(answer, r'(?i)"verdict"\s*:\s*(true|false)', 1)
    return F.coalesce(strict, inner, F.when(F.lower(field) == "true", True).when(F.lower(field) == "false", False))


def strip_markup(html: Column, depth: int = 6) -> Column:
    """Text of marked-up pages: comments, scripts and styles go, nested wiki templates and
    links are unwrapped from the inside out ``depth`` times, tags become spaces."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(script|style|ref)\b[^>]*>.*?</\1>", "")
    for _ in range(depth):
        out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", "")
    for _ in range(depth):
        out = F.regexp_replace(out, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    out = F.regexp_replace(out, r"'{2,}", "")
    out = F.regexp_replace(out, r"(?m)^=+[ \t]*(.*?)[ \t]*=+[ \t]*$", "$1")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r"\s*\n\s*", "\n"))


#: The passes of wiki clean-up in their order, as (pattern, replacement, repeated);
#: repeated ones run until nothing changes, here ``depth`` times.
WIKI_PASSES = (
    (r"(?s)<!--.*?-->", "", False),
    (r"(?is)<ref[^>]*>.*?</ref>", "", False),
    (r"(?i)<ref[^/]*/\s*>", "", False),
    (r"(?s)<[^>]+>", "", False),
    (r"\{\{[^{}]*\}\}", "", True),
    (r"(?i)\[\[(?!(?:File|Image|Media):)([^\[\]|]*\|)?([^\[\]]+)\]\]", "$2", True),
    (r"(?i)\[\[(?:File|Image|Media):[^\[\]]*\]\]", "", True),
    (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1", False),
    (r"\[https?://[^\s\]]+\s+([^\]]+)\]", "$1", False),
    (r"\[https?://[^\]]+\]", "", False),
    (r"'{2,3}", "", False),
    (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1", False),
    (r"(?im)^#REDIRECT.*$", "", False),
    (r"(?m)^-{4,}\s*$", "", False),
    (r"(?m)^\s*[|!].*$", "", False),
    (r"(?m)^[;:*#]+\s*", "", False),
    (r"\n{3,}", "\n\n", False),
)


def wiki_text(markup: Column, depth: int = 8) -> Column:
    """Plain text of wiki markup; templates, links and file blocks are undone from the inside out,
    down to ``depth`` levels."""

    def passed(pattern: str, to: str):
        return lambda t, _: F.regexp_replace(t, F.lit(pattern), F.lit(to))

    out = markup
    for pattern, to, repeated in WIKI_PASSES:
        step = passed(pattern, to)
        out = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), out, step) if repeated else step(out, None)
    return F.regexp_replace(out, r"^\s+|\s+$", "")
