"""Column builders for text: tokens, query forms, keys, features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.words import ENGLISH_LONG, ENGLISH_SHORT, HTML_WORDS, MARKUP_WORDS

#: White space as Python's str.split() has it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
TAG = "<[^>]+>"
ENTITY = r"&(quot|amp|lt|gt|nbsp|apos|#\d+);"


def given(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def simple(text: Column) -> Column:
    """All runs of ASCII letters and digits of the lower-case text."""
    return F.regexp_extract_all(F.lower(given(text)), F.lit("[A-Za-z0-9]+"), F.lit(0))


def without(tokens: Column, words: list[str]) -> Column:
    """Tokens that aren't in ``words``, with repeats."""
    return F.filter(tokens, lambda t: ~t.isin(*words))


def tokenizer(stop: list[str] | None = None, drop_html: bool = False, min_length: int = 1) -> Callable[[Column], Column]:
    """A tokenizer from switches: HTML words, then stop words, then short words go."""

    def tokens(text: Column) -> Column:
        out = simple(text)
        for words in (HTML_WORDS if drop_html else None, stop):
            out = without(out, words) if words else out
        return F.filter(out, lambda t: F.length(t) >= min_length) if min_length > 1 else out

    return tokens


def possessive_free(text: Column) -> Column:
    return F.regexp_replace(F.lower(given(text)), r"'s\b", "")


def english(text: Column) -> Column:
    """Possessives and the short stop list dropped; stems are a join, see ``porter.with_stems``."""
    return without(simple(possessive_free(text)), ENGLISH_SHORT)


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "simple": simple,
    "lucene_like": english,
    "nohtml": tokenizer(drop_html=True),
    "nohtml_stop": tokenizer(stop=ENGLISH_LONG, drop_html=True),
}
#: Tokenizers that are ``simple`` without some words, and these.
PLAIN = {"simple": [], "nohtml": HTML_WORDS, "nohtml_stop": [*HTML_WORDS, *ENGLISH_LONG]}
#: Tokenizers whose tokens are stemmed afterwards.
STEMMED = {"lucene_like"}


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def stripped(text: Column) -> Column:
    """Tags, then entities, then runs of white space become one space."""
    return _tidy(F.regexp_replace(F.regexp_replace(given(text), TAG, " "), ENTITY, " "))


def stripped_entities_first(text: Column) -> Column:
    return _tidy(F.regexp_replace(F.regexp_replace(given(text), ENTITY, " "), TAG, " "))


def title(text: Column) -> Column:
    """What stands before the first ``<p>``; all if there is none."""
    return F.substring_index(given(text), "<p>", 1)


def body(text: Column) -> Column:
    """From the first ``<p>`` on; empty if there is none."""
    at = F.locate("<p>", given(text))
    return F.when(at > 0, F.substring(given(text), at, F.length(text))).otherwise("")


def title_weighted(text: Column) -> Column:
    """The title three times before the text, then stripped."""
    return stripped(F.concat(F.repeat(F.concat(title(text), F.lit(" ")), 3), given(text)))


FORMS: dict[str, Callable[[Column], Column]] = {
    "raw": given,
    "stripped": stripped,
    "title": lambda t: stripped(title(t)),
    "title_weighted": title_weighted,
}


#: A registered name, or the function itself.
Named = str | Callable[[Column], Column]


def made_by(named: Named, known: dict[str, Callable[[Column], Column]]) -> Callable[[Column], Column]:
    return named if callable(named) else known[named]


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(given(text), SPACE), lambda w: w != ""))


def content_key(text: Column) -> Column:
    """SHA-1 of the text with single spaces, in lower case."""
    return F.sha1(F.lower(_tidy(given(text))).cast("binary"))


def content_hash(text: Column) -> Column:
    return F.sha1(given(text).cast("binary"))


def has_tag(text: Column) -> Column:
    return given(text).rlike(TAG)


def has_year(text: Column) -> Column:
    return given(text).rlike(r"(?U)\b(19|20)\d{2}\b")


def markup_words(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*MARKUP_WORDS)))


def id_shape(doc_id: Column) -> Column:
    """Long, short or other; for reports only, never for ranking."""
    # fixed values: the two patterns of ids
    return F.when(doc_id.rlike(r"^[^/]+/\d+_[0-9a-f]{16}_\d+\.txt$"), "long").when(doc_id.rlike(r"^[^/]+/[0-9a-f]{8}_\d+\.txt$"), "short").otherwise("other")


def clipped(text: Column, size: int) -> Column:
    return F.substring(given(text), 1, size)
