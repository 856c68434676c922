"""Models behind operators: interfaces with deterministic fallbacks that need no service.

A provider is chosen by name from a registry; the defaults are what the library
does when no model answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let, nonempty

REGISTRY: dict[tuple[str, str], Callable] = {}


def provider(kind: str, name: str) -> Callable[[Callable], Callable]:
    def put(f: Callable) -> Callable:
        REGISTRY[kind, name] = f
        return f

    return put


def get(kind: str, name: str = "offline") -> Callable:
    try:
        return REGISTRY[kind, name]
    except KeyError:
        raise ValueError(f"no {kind} provider {name!r}; known: {sorted(n for k, n in REGISTRY if k == kind)}") from None


@provider("expand", "offline")
def same_question(question: Column) -> Column:
    """Hypotheses for a question: the question."""
    return F.array(question)


@provider("embed", "offline")
def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Signed feature hashing of words into ``dim`` numbers; a zero vector for a blank text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    at = lambda i: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dim)) == i, F.when(h < 0, -1.0).otherwise(1.0)).otherwise(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: at(i).cast("float"))


@provider("sparse", "offline")
def term_map(text: Column) -> Column:
    """Words and how often each occurs."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.size(F.filter(words, lambda x: x == w)).cast("float"))))


@provider("rerank", "offline")
def no_score(question: Column, text: Column) -> None:
    """No score: the fused order stays."""
    return None


@provider("compress", "offline")
def whole_passage(passage: Column, question: Column) -> Column:
    return passage


@provider("translate", "offline")
def untranslated(text: Column, lang: Column) -> Column:
    return text


# Words that tell the languages of the tables apart.
STOP_WORDS = {"en": ("the", "of", "and", "is", "to"), "fr": ("le", "les", "des", "et", "une"), "de": ("der", "die", "und", "den", "ist"), "es": ("el", "los", "las", "que", "y")}


@provider("language", "offline")
def by_stop_words(text: Column, first: int | None = 500) -> Column:
    """The language with the most stop words among the ``first`` characters (None: all); English if none has any."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(F.lower(text if first is None else F.substring(text, 1, first)), r"(?U)\W+")
    known = F.filter(words, lambda w: w.isin(*(x for lang in STOP_WORDS.values() for x in lang)))
    score = lambda found, lang: F.size(F.filter(found, lambda w: w.isin(*STOP_WORDS[lang])))

    def likeliest(scores: Column) -> Column:
        best, out = F.array_max(scores), F.lit("en")
        for n, lang in reversed([(n, x) for n, x in enumerate(STOP_WORDS) if x != "en"]):
            out = F.when((scores[n] == best) & (scores[list(STOP_WORDS).index("en")] < best), lang).otherwise(out)
        return out

    # words are told apart once, and only stop words looked at again
    return F.when(nonempty(text), let(known, lambda found: let(F.array(*(score(found, x) for x in STOP_WORDS)), likeliest))).otherwise("en")


@provider("context", "metadata")
def metadata_context(**columns: Column) -> Column:
    from corpusloom.functions.text import context_line

    return context_line(**columns)


@provider("answer", "offline")
def top_passages(candidates, **options):
    from corpusloom.operators.retrieval import fallback_answer

    return fallback_answer(candidates, **options)


# Templates of the prompts that a model provider is given.
EXTRACTION_PROMPT = "List the persons in the text and the relations between them as one JSON object with the keys persons and relationships.\n\nTEXT:\n%s"
QUESTION_PROMPT = "Question: %s\n\nAnswer it from these passages and from nothing else, and after each statement name the passage that it rests on as [Source N].\n\n%s"


def prompt(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)
