"""Text expressions.  All are built-in functions, so they stay inside generated code.

Java's ``\\w`` and ``\\s`` are ASCII; ``(?U)`` gives the Unicode classes.  Spark's
``trim`` strips spaces only, ``strip`` here strips all white space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CHUNK_CHARS = 80
#: Words whose full stop ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Rev", "Sr", "Jr", "St", "Vol", "vol", "No", "no", "pp", "p", "cf", "ibid", "et al", "op", "cit", "fig", "Fig", "ed", "Ed", "trans", "Trans", "repr", "Repr", "approx", "dept", "est")
#: What LaTeX reads as commands, and how it is written as text.
TEX = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}
#: Parts of a field's name and the domain they point to.
SCIENCE = ("math", "physics", "chem", "bio", "astro", "science")
PHILOSOPHY = ("philos", "logic", "ethics", "metaphys")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: an expression that is used in several places inside lambdas would be computed in each."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """The key that names are matched by."""
    return F.lower(strip(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def nonempty(c: Column) -> Column:
    """Text that is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def collapsed(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def page_text(c: Column) -> Column:
    """A page's text with hyphen breaks joined, single line breaks as spaces and paragraph breaks kept."""
    c = F.regexp_replace(c, "\n{2,}", "\u0001")
    c = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    c = F.regexp_replace(F.regexp_replace(c, "\n", " "), "\u0001", "\n\n")
    return strip(F.regexp_replace(c, "  +", " "))


def layer_text(c: Column) -> Column:
    """A region's text for reading; ``c`` is in composed form (``unicode.nfc``)."""
    # most regions are one line, which neither pattern need be tried on
    joined = F.regexp_replace(F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2"), r"(?<!\n)\n(?!\n)", " ")
    c = F.when(F.contains(c, F.lit("\n")), joined).otherwise(c)
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def differs(a: Column, b: Column) -> Column:
    return collapsed(a) != collapsed(b)


def token_count(c: Column) -> Column:
    """Four thirds of the words, rounded down: the count for want of a tokenizer."""
    words = F.size(F.filter(F.split(strip(c), r"(?U)\s+"), lambda x: x != ""))
    return F.floor(words * 4 / 3).cast("int")


# The ends of paragraphs, and of what may be a sentence.
PARAGRAPH = r"\n{2,}"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-ZÀ-ɏ\d\"‘“])"
_MARK = "\uffff"  # no character, so in no text


def sentences(c: Column) -> Column:
    """The sentences of a text, in order.

    Paragraphs are split after ``.``, ``!`` or ``?`` before a capital letter, digit
    or opening quote; a piece that follows an abbreviation or a single capital
    letter is joined to the one before, across paragraphs too.  Breaks are marked,
    and those after abbreviations taken back, each in one pass over the text.
    """
    pieces = F.filter(F.transform(F.split(c, f"(?U){PARAGRAPH}|{SENTENCE_END}"), strip), lambda p: p != "")
    open_ = r"(?U)(\b(?:" + "|".join((*ABBREVIATIONS, "[A-Z]")) + rf")\n?\.*){_MARK}"
    joined = F.regexp_replace(F.array_join(pieces, _MARK), open_, "$1 ")
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, _MARK))


def tex(c: Column) -> Column:
    """LaTeX's special characters escaped so that no escape is escaped.

    Characters whose escapes have braces or backslashes of their own are marked
    first and written last; a text that holds a mark goes character by character.
    """
    text = F.coalesce(c, F.lit(""))
    marks = {"\\": "\u0001", "~": "\u0002", "^": "\u0003"}
    out = F.translate(text, "".join(marks), "".join(marks.values()))
    out = F.regexp_replace(out, r"([&%$#_{}])", r"\\$1")
    for char, mark in marks.items():
        out = F.replace(out, F.lit(mark), F.lit(TEX[char]))
    special = F.create_map(*(F.lit(x) for pair in TEX.items() for x in pair))
    slow = F.array_join(F.transform(F.split(text, ""), lambda x: F.coalesce(F.element_at(special, x), x)), "")
    return F.when(text.rlike("[\u0001-\u0003]"), slow).otherwise(out)


def slug_plain(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as ``_``, one ``_`` off each end."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def person_key(name: Column, birth_year: Column, mark: str = "_") -> Column:
    """``name_1707`` or ``name_unknown``; ``mark`` stands for spaces and before the year."""
    clean = F.replace(strip(F.lower(F.regexp_replace(name, r"(?U)[^\w\s]", ""))), F.lit(" "), F.lit(mark))
    return F.concat(clean, F.lit(mark), F.coalesce(birth_year.cast("string"), F.lit("unknown")))


def domains(field: Column) -> Column:
    low = F.lower(F.coalesce(field, F.lit("")))
    any_of = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return F.array_compact(F.array(F.lit("domain_history"), F.when(any_of(SCIENCE), "domain_science"), F.when(any_of(PHILOSOPHY), "domain_philosophy")))


def document_identity(file_name: Column, title: Column, author: Column, year: Column) -> Column:
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    shown = F.when(nonempty(title) & (F.lower(title) != F.lower(stem)), title)
    return F.concat_ws(" — ", file_name, shown, F.when(nonempty(author), F.concat(F.lit("by "), author)), F.when(nonempty(year.cast("string")), year.cast("string")))


def context_line(title: Column, author: Column, year: Column, page: Column, pages: Column, file_name: Column) -> Column:
    """``From: author, title, (year), p. 3 of 9.`` with the parts that are there."""
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    parts = F.concat_ws(", ", blank_to_null(author), blank_to_null(F.coalesce(blank_to_null(title), stem)), F.when(nonempty(year.cast("string")), F.concat(F.lit("("), year.cast("string"), F.lit(")"))))
    total = F.when(F.coalesce(pages, F.lit(0)) != 0, F.concat(F.lit(" of "), pages.cast("string"))).otherwise("")
    shown = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", p. "), page.cast("string"), total)).otherwise("")
    return F.concat(F.lit("From: "), F.coalesce(blank_to_null(parts), file_name, F.lit("unknown")), shown, F.lit("."))


def embedded_text(context: Column, text: Column) -> Column:
    return F.when(nonempty(context), F.concat(context, F.lit("\n\n"), text)).otherwise(text)


def file_size(size: Column) -> Column:
    """``12.0 MB``: each unit floors, so the fraction is always 0."""
    unit = lambda n, name: F.concat(F.format_string("%.1f", F.floor(size / n).cast("double")), F.lit(f" {name}"))
    out = unit(1024**3, "GB")
    for n, name in ((1024**2, "MB"), (1024, "KB"), (1, "B")):
        out = F.when(size < n * 1024, unit(n, name)).otherwise(out)
    return F.when(size.isNull(), F.lit("—")).otherwise(out)


def compact_names(names: Column, limit: int = 2000) -> Column:
    more = F.concat(F.to_json(F.slice(names, 1, limit)), F.lit("\n// ... and "), (F.size(names) - limit).cast("string"), F.lit(" more"))
    return F.when(F.size(names) <= limit, F.to_json(names)).otherwise(more)


def short_model(c: Column) -> Column:
    return F.replace(F.element_at(F.split(c, "/"), -1), F.lit(":free"), F.lit(""))


def lifespan(birth: Column, death: Column) -> Column:
    shown = lambda y: F.coalesce(y.cast("string"), F.lit("?"))
    return F.when(birth.isNull() & death.isNull(), F.lit("")).otherwise(F.concat(shown(birth), F.lit("–"), shown(death)))


def era_key(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit("unassigned"))


def dates_note(birth: Column, death: Column) -> Column:
    """``(1707–1783)``, ``(1707)`` or nothing; a year 0 counts as missing."""
    b, d = F.nullif(birth, F.lit(0)), F.nullif(death, F.lit(0))
    return F.when(b.isNotNull() & d.isNotNull(), F.concat(F.lit("("), b.cast("string"), F.lit("–"), d.cast("string"), F.lit(")"))).when(b.isNotNull(), F.concat(F.lit("("), b.cast("string"), F.lit(")"))).otherwise("")


def is_scanned(text_length: Column, file_bytes: Column, ratio: float = 0.3) -> Column:
    return (F.coalesce(file_bytes, F.lit(0)) == 0) | (text_length / file_bytes < ratio)


def excluded(path: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(path), F.lit(p.lower())) for p in parts), F.lit(False))
