"""Text cleaning, titles, keys and display strings as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import lexicon as lx

WS = lx.SPACE_CLASS


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row.

    Inside a lambda an outer expression would be evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(lx.SPACE_CHARS))


def flatten_space(text: Column) -> Column:
    """Any whitespace run becomes one space; ends trimmed (T3, and T10 without the cut)."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x00{WS}]+", " "), F.lit(" "))


def normalise(text: Column) -> Column:
    """Blank runs to one space, three or more newlines to two, stripped."""
    blanks = F.regexp_replace(text, r"[\x00 \t\r\f\x0b]+", " ")
    return strip(F.regexp_replace(blanks, r"\n{3,}", "\n\n"))


def clean(text: Column) -> Column:
    """T1 plus byte-order marks, backspaces and wide Unicode spaces."""
    text = F.regexp_replace(text, r"[\x{feff}\x08]", "")
    text = F.regexp_replace(text, r"[\x00 \t\r\f\x0b\x{2002}-\x{200a}\x{3000}]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_title(title: Column) -> Column:
    """Drop control and zero-width marks, page numbers, dot leaders, edge marks (T4)."""
    title = F.regexp_replace(F.coalesce(title, F.lit("")), r"[\x08\x00\x{fffd}\x{feff}\x{200b}]", "")
    title = F.regexp_replace(title, r"[\x{2002}\x{2003}\x{202f}\x{3000}\xa0 \t\r\f\x0b]+", " ")
    title = F.regexp_replace(title, r"\n+", " ")
    title = F.regexp_replace(title, rf"[{WS}]+\p{{Nd}}+$", "")
    title = F.regexp_replace(title, r"\.+$", "")
    return F.btrim(strip(title), F.lit(lx.TITLE_EDGE_PUNCTUATION))


def is_valid_title(title: Column, noise: Sequence[str] | None = None) -> Column:
    """Predicate on a raw title (T5)."""
    cleaned = clean_title(title)
    size = F.length(cleaned)
    letters = F.regexp_count(cleaned, F.lit(r"[\x{4e00}-\x{9fff}A-Za-z]"))
    marks = F.regexp_count(cleaned, F.lit(r"[，。、；：]"))
    ok = (F.length(title) >= 2) & (size >= 2) & (size <= 80) & (letters >= 2)
    ok = ok & ~((size > 10) & (marks / size > 0.4))
    for pattern in noise if noise is not None else lx.TITLE_NOISE_PATTERNS:
        ok = ok & ~cleaned.rlike("(?U)" + pattern)
    return F.coalesce(ok & ~cleaned.isin(lx.FRONT_MATTER_TITLES), F.lit(False))


def file_stem(name: Column) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def document_key(name: Column) -> Column:
    """What tells documents apart by name: as `document_id`, but of the whole stem."""
    key = F.btrim(F.regexp_replace(file_stem(name), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.when(F.length(key) < 3, F.md5(F.encode(name, "UTF-8"))).otherwise(key)


def document_id(name: Column) -> Column:
    """`book_` + first 20 word characters of the stem, or an md5 prefix."""
    key = F.regexp_replace(file_stem(name), r"[^\p{L}\p{N}]+", "_")
    key = F.btrim(key, F.lit("_"))
    short = F.substring(F.md5(F.encode(name, "UTF-8")), 1, 8)
    return F.concat(F.lit("book_"), F.when(F.length(key) < 3, short).otherwise(F.substring(key, 1, 20)))


def book_title(name: Column, titles: dict[str, str] | None = None) -> Column:
    """Known title, else the name without number prefix and extension."""
    titles = lx.BOOK_TITLES if titles is None else titles
    bare = strip(F.regexp_replace(F.regexp_replace(name, r"^\p{Nd}+_", ""), r"(?i)\.(pdf|md|txt|docx)$", ""))
    if not titles:
        return bare
    known = F.create_map(*[F.lit(v) for pair in titles.items() for v in pair])
    return F.coalesce(F.try_element_at(known, name), bare)


def infer_chapter(text: Column, pattern: str = lx.PAGE_CHAPTER, first_lines: int = 12, width: int = 80) -> Column:
    """First of the first lines that matches, cut to `width`, else the unknown label."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, first_lines), strip)
    return F.coalesce(
        F.substring(F.get(F.filter(lines, lambda line: line.rlike(pattern)), F.lit(0)), 1, width),
        F.lit(lx.UNKNOWN_CHAPTER),
    )


def keywords(text: Column, limit: int = 8, stop: Sequence[str] = tuple(lx.KEYWORD_STOP)) -> Column:
    """Distinct runs of two or more word characters in first-seen order."""
    runs = F.regexp_extract_all(text, F.lit(lx.KEYWORD_PATTERN), F.lit(0))
    kept = F.filter(runs, lambda word: ~word.isin(list(stop))) if stop else runs
    return F.slice(F.array_distinct(kept), 1, limit)


def quote(text: Column, limit: int) -> Column:
    """Whitespace collapsed, then cut."""
    return F.substring(flatten_space(text), 1, limit)


def short_text(text: Column, limit: int = 180) -> Column:
    """As T10, with an ellipsis only when something was cut."""
    flat = flatten_space(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("...")))


def stable_id(*parts: Column | str, length: int = 16) -> Column:
    """sha1 prefix over the parts joined by `::`.

    Sixteen hex digits are 64 bits; a corpus of billions of chunks should ask for more.
    """
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.substring(F.sha1(F.encode(F.concat_ws("::", *[c.cast("string") for c in cols]), "UTF-8")), 1, length)


def page_label(start: Column, end: Column) -> Column:
    has_start = F.coalesce(start != 0, F.lit(False))
    spans = has_start & F.coalesce((end != 0) & (start != end), F.lit(False))
    return (
        F.when(spans, F.concat_ws("-", start.cast("string"), end.cast("string")))
        .when(has_start, start.cast("string"))
        .otherwise(F.lit(lx.UNKNOWN_PAGE))
    )


def or_default(value: Column, default: str) -> Column:
    """Null and empty both mean missing."""
    return F.when(F.length(value) > 0, value).otherwise(F.lit(default))


def source_line(book: Column, chapter: Column, start: Column, end: Column) -> Column:
    """`book / chapter / page a-b` with labels for what is unknown."""
    return F.concat(
        or_default(book, lx.UNKNOWN_BOOK),
        F.lit(" / "),
        or_default(chapter, lx.UNKNOWN_SECTION),
        F.lit(" / 页码 "),
        page_label(start, end),
    )


def citation_complete(book: Column, chapter: Column, start: Column, end: Column) -> Column:
    """Book and chapter are present, and at least one page."""
    named = (F.length(book) > 0) & (F.length(chapter) > 0)
    return F.coalesce(named, F.lit(False)) & (start.isNotNull() | end.isNotNull())


def context_fields(score: Column, text: Column) -> list[Column]:
    """Score to six decimals and a 280-character snippet."""
    return [F.round(score, 6).alias("score"), F.substring(text, 1, 280).alias("snippet")]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit
