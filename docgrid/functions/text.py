"""Column expressions over text. All are built-in Spark expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must match what the documents' conventions are. Case is ignored where the name says _ANY.
CHAPTER_PATTERNS_ANY = (
    r"Chapter\s+\d+", r"第[一二三四五六七八九十百千万]+章", r"第\d+章", r"Section\s+\d+", r"§\s*\d+", r"Part\s+[IVXLCDM]+",
    r"Appendix\s+[A-Z0-9]+", r"附录\s*[A-Z0-9]?", r"Index$", r"References$", r"Bibliography$", r"Conclusion$", r"Abstract$", r"Introduction$",
)
HEADING_PATTERNS_ANY = (
    r"(Chapter|CHAPTER)\s+\d+[:\s].*", r"(第[一二三四五六七八九十百千万]+章)\s*", r"\d+\.\s+[A-Z][^.]+$", r"#{1,3}\s+.+", r"Part\s+[IVXLCDM]+\s*", r"Section\s+\d+[:\s].*",
)
FOOTNOTE_PATTERNS = (r"\[\d+\]\s+", r"\d+\)\s+", r"\*\s+\d+\s+\*.*$")
CAPTION_PATTERNS_ANY = (r"(Figure|Table|Diagram|Chart)\s+\d+[:\.-].*", r"(图|表)\s+\d+[:\.-].*", r"(Fig|Tab|Ex)\.?\s+\d+[:\.-].*")
ANNOTATION_MARKERS = ("†", "‡", "‡‡", "*", "Note:", "注:", "Remark:")
CAPTION_STARTS = ("fig.", "figure", "table", "图表", "图", "表", "caption")
CALLOUT_STARTS = ("note:", "tip:", "warning:", "注意", "提示", "警告")
HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def collapse(text) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return strip(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def is_blank(text) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(strip(text), F.lit("")) == ""


def starts_with_any(text, starts: tuple[str, ...]) -> Column:
    t, out = _c(text), F.lit(False)
    for s in starts:
        out = out | t.startswith(s)
    return out


def matches_any(text, patterns: tuple[str, ...], ignore_case: bool) -> Column:
    """Whether the stripped text begins with one of the patterns."""
    return strip(text).rlike(f"(?{'iu' if ignore_case else ''}U)^(?:{'|'.join(patterns)})")


def is_chapter_pattern(text) -> Column:
    return matches_any(text, CHAPTER_PATTERNS_ANY, True)


def is_heading_pattern(text) -> Column:
    return matches_any(text, HEADING_PATTERNS_ANY, True)


def is_footnote_pattern(text) -> Column:
    return matches_any(text, FOOTNOTE_PATTERNS, False)


def is_caption_pattern(text) -> Column:
    return matches_any(text, CAPTION_PATTERNS_ANY, True)


def has_annotation_marker(text) -> Column:
    return F.exists(F.array(*map(F.lit, ANNOTATION_MARKERS)), lambda m: F.contains(_c(text), m))


def heading_level(text) -> Column:
    """1 for chapters, 2 for sections and numbered titles, else 3."""
    t = strip(text)
    return F.when(t.rlike(r"(?iuU)^(?:Chapter\s+\d+|第[一二三四五六七八九十百千万]+章)"), 1).when(t.rlike(r"(?iuU)^(?:Section\s+\d+|\d+\.\s+)"), 2).otherwise(3)


def is_chinese_char(char) -> Column:
    return _c(char).rlike(f"^{HAN}$")


def colour_hex(rgb) -> Column:
    """#rrggbb of an array of parts from 0 to 1, cut off to whole numbers; empty for fewer than three parts."""
    c = _c(rgb)
    two = lambda i: F.lower(F.lpad(F.hex((c[i] * 255).cast("long")), 2, "0"))
    return F.when(F.coalesce(F.size(c), F.lit(0)) >= 3, F.concat(F.lit("#"), two(0), two(1), two(2))).otherwise("")


def word_count(text) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def normalise_content(text, drop_page_numbers: bool = True) -> Column:
    """Header or footer text for comparison: white space collapsed, page numbers left out."""
    t = collapse(text)
    if drop_page_numbers:
        t = F.regexp_replace(t, r"(?iU)page\s*\d+", "")
        t = strip(F.regexp_replace(t, r"(?U)\s*\d+\s*$", ""))
    return t


def normalise_edge(text) -> Column:
    return F.lower(collapse(text))


def anchor(text) -> Column:
    """A link anchor: lower case, only a-z, 0-9 and hyphens, none at the ends."""
    t = F.regexp_replace(F.lower(_c(text)), r"(?U)[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", "-"), r"^-+|-+$", "")


def cell_text(text, width: int = 100) -> Column:
    """A table cell for Markdown: white space collapsed, pipes escaped, cut to `width` with dots."""
    t = F.replace(collapse(F.coalesce(_c(text), F.lit(""))), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t)


def truncate_words(text, words: int) -> Column:
    """The first words with dots after them; the text itself if it has no more than that."""
    parts = F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(parts) <= words, _c(text)).otherwise(F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("...")))


def title_case_simple(text) -> Column:
    """Underscores and hyphens as spaces, each word capitalised; like str.title for words of letters only."""
    return F.initcap(F.translate(_c(text), "_-", "  "))


def toc_line(line) -> Column:
    """struct(level, title, page) of a table-of-contents line: hashes give the level, ``(page n)`` the page, 0 if it lacks."""
    t = _c(line)
    page = F.regexp_extract(t, r"(?iU)\(page\s+(\d+)\)", 1)
    title = strip(F.replace(F.regexp_replace(t, r"(?iU)\(page\s+\d+\)", ""), F.lit("#"), F.lit("")))
    return F.struct(F.regexp_count(t, F.lit("#")).alias("level"), title.alias("title"), F.coalesce(F.expr("cast(null as int)"), F.when(page == "", 0).otherwise(page.try_cast("int")), F.lit(0)).alias("page"))


def stem(path) -> Column:
    """File name without folder and last suffix."""
    name = F.element_at(F.split(_c(path), "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
