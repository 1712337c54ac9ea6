"""Column functions on text. All but one run inside the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

SENTENCE_BREAK = r"[.!?]\s+"
PARAGRAPH_BREAK = "</p><p>"
SENT_SEPARATOR = "<SENT>"

# Phrases that mark a sentence as site furniture. Matched as lower-case substrings.
BOILERPLATE_PHRASES = (
    "share on whatsapp", "share on messenger", "reuse this content", "share on linkedin",
    "share on pinterest", "share on google+", "listen /", "– politics weekly",
    "sorry your browser does not support audio", "https://flex.acast.com", "|",
    "share on facebook", "share on twitter", "share via email", "sign up to receive",
    "this article is part of a series", "follow guardian", "twitter, facebook and instagram",
    "uk news news", "click here to upload it", "do you have a photo", "email view",
    "read more guardian", "this series is", "readers can recommend ", "join the debate",
    "guardian.letters@theguardian.com", "more information", "close",
    "all our journalism is independent", "is delivered to thousands of inboxes every weekday",
    "with today’s essential stories", "newsflash:", "you can read terms of service here",
    "guardian rating:", "by clicking on an affiliate link", "morning briefing news", "analysis:",
    "good morning, and welcome to our rolling coverage", "south and central asia news",
    "f you have a direct question", "sign up to the", "you can read terms of service here.",
    "if you want to attract my attention quickly, it is probably better to use twitter.",
    "uk news",
)
# Case-sensitive rules on the beginning, the end and the inside of a sentence.
BOILERPLATE_STARTS = (
    "Updated ", "Here’s the sign-up", "[Read more on", "[Here’s the list of",
    "[Follow our live coverage", "[",
)
BOILERPLATE_INSIDE = ("Want to get this briefing by email", "Thank youTo")
BOILERPLATE_ENDS = ("]",)

# English function words left out of token comparisons.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very can will just should now".split()
)

# Latin letters with a mark and their plain form, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def as_column(value) -> Column:
    """Accept a column or a column name."""
    return value if isinstance(value, Column) else F.col(value)


def sentence_pieces(text) -> Column:
    """Array of the pieces of a text between sentence ends."""
    return F.split(as_column(text), SENTENCE_BREAK, -1)


def tokens(text) -> Column:
    """Array of lower-cased tokens, empty ones left out."""
    return F.array_remove(F.split(F.lower(as_column(text)), r"\s+", -1), "")


def raw_tokens(text) -> Column:
    """Array of tokens as written, empty ones left out."""
    return F.array_remove(F.split(as_column(text), r"\s+", -1), "")


def token_count(text) -> Column:
    return F.size(raw_tokens(text))


# ASCII punctuation at the beginning or the end of a token
_EDGE_PUNCTUATION = r"(?<!\S)[!-/:-@\[-`{-~]++|[!-/:-@\[-`{-~]++(?!\S)"


def content_tokens(text) -> Column:
    """Lower-cased tokens without surrounding ASCII punctuation, function words left out."""
    bare = F.regexp_replace(F.lower(as_column(text)), _EDGE_PUNCTUATION, "")
    # a long literal list is looked up in a hash set
    return F.filter(F.split(bare, r"\s+", -1), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def plain_letters(text) -> Column:
    """Replace marked Latin letters by their plain form; every character keeps its place."""
    return F.translate(as_column(text), ACCENTED, PLAIN)


def fold_latin(text) -> Column:
    """Replace marked Latin letters by their plain form and drop whatever else is not ASCII."""
    return F.regexp_replace(plain_letters(text), r"[^\x00-\x7F]", "")


def strip_markup(text) -> Column:
    """Plain text of an HTML fragment: tags out, white space collapsed, trimmed."""
    spaced = F.regexp_replace(as_column(text), PARAGRAPH_BREAK, " ")
    bare = F.regexp_replace(spaced, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def clean_html(page) -> Column:
    """Body of a monitored article page: footer and header lines out, outer tags out."""
    lines = F.split(as_column(page), PARAGRAPH_BREAK, -1)
    last = F.element_at(lines, -1)
    body = F.when(
        last.rlike(r"Currently monitoring [0-9,]+ news articles"),
        F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))),
    ).otherwise(lines)

    def drop_first(arr, condition):
        first = F.coalesce(F.get(arr, 0), F.lit(""))
        return F.when(condition(first), F.slice(arr, 2, F.greatest(F.size(arr), F.lit(1)))).otherwise(arr)

    body = drop_first(body, lambda s: s.startswith("<p><a href"))
    body = drop_first(body, lambda s: s.rlike(r"Version [0-9]+ of [0-9]+"))
    joined = F.array_join(body, PARAGRAPH_BREAK)
    joined = F.regexp_replace(joined, r"^<p>", "")
    joined = F.regexp_replace(joined, r"</p>$", "")
    return F.regexp_replace(joined, r"&lt;.*?&gt;", "")


def is_boilerplate(
    sentence,
    phrases=BOILERPLATE_PHRASES,
    starts=BOILERPLATE_STARTS,
    inside=BOILERPLATE_INSIDE,
    ends=BOILERPLATE_ENDS,
) -> Column:
    """True where a sentence is site furniture."""
    s = as_column(sentence)

    def any_of(tests):
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    # one-element array: the lower-cased text is made once, not once per phrase
    in_phrases = F.exists(F.array(F.lower(s)), lambda low: any_of(low.contains(p) for p in phrases))
    rules = [s.startswith(p) for p in starts] + [s.contains(p) for p in inside] + [s.endswith(p) for p in ends]
    return any_of(rules) | in_phrases


def dateline(text, dash: str = "—", max_tokens: int = 6, places: Column | None = None) -> Column:
    """Short place line before the first dash, or NULL.

    A line is one if it has a word in upper case or, where ``places`` (an array of lower-case names)
    is given, a word that is one of these names.
    """
    t = as_column(text)
    head = F.substring_index(t, dash, 1)
    short = F.size(raw_tokens(head)) < max_tokens
    named = F.exists(
        raw_tokens(head), lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    )
    if places is not None:
        named = named | F.arrays_overlap(content_tokens(head), places)
    return F.when(t.contains(dash) & short & named, F.trim(head))


_BLANK = r"[ \t\r\n\f\v]"
# a number in Roman numerals: thousands, hundreds, tens, ones, at least one of them
ROMAN = (
    "(?:M+(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})|(?:CM|CD|DC{0,3}|C{1,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
    "|(?:XC|XL|LX{0,3}|X{1,3})(?:IX|IV|V?I{0,3})|(?:IX|IV|VI{0,3}|I{1,3}))"
)
# marks of numbered lists: Roman numerals, "A.", "(A)", in this order
LIST_MARKS = (
    rf"(?i)(?:{_BLANK}|\(){ROMAN}(?:{_BLANK}|\))", rf"^{_BLANK}*WORD+\.{_BLANK}*", rf"{_BLANK}*\(WORD+\){_BLANK}*",
)


@F.pandas_udf(StringType())
def strip_list_marks(texts: pd.Series) -> pd.Series:
    """Texts without marks of numbered lists; removal goes on until nothing is left to remove."""
    # a word that is no number is passed over at once
    numeral = LIST_MARKS[0].replace("(?:M+", rf"(?=[MDCLXVI]+(?:{_BLANK}|\)))(?:M+", 1)
    roman, head, bracket = (re.compile(m.replace("WORD", r"\w")) for m in (numeral, *LIST_MARKS[1:]))

    def strip(text: str | None) -> str | None:
        before = None
        while text is not None and text != before:
            before = text
            text = roman.sub("", text)
            first = head.match(text)  # stands at the beginning only
            text = text[first.end():] if first else text
            text = bracket.sub("", text) if "(" in text else text
        return text

    return texts.map(strip, na_action="ignore")


def highlight(text, terms, front: str = "<m>", back: str = "</m>") -> Column:
    """Wrap each occurrence of a term, whatever its case."""
    pattern = "(?i)(" + "|".join(re.escape(t) for t in terms) + ")"
    return F.regexp_replace(as_column(text), pattern, f"{front}$1{back}")


def bigrams(token_array: Column) -> Column:
    """Array of neighbouring token pairs joined by a space."""
    return ngrams(token_array, 2)


def ngrams(token_array: Column, n: int) -> Column:
    """Array of n-token runs joined by a space."""
    starts = F.sequence(F.lit(1), F.size(token_array) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(token_array, i, F.lit(n)), " "))
    return F.when(F.size(token_array) >= n, runs).otherwise(F.array().cast("array<string>"))


def text_key(text) -> Column:
    """128 bits that stand for a text wherever rows only meet by equal texts."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text) if isinstance(text, str) else text).alias("h2"))


def token_hashes(text) -> Column:
    """One 64-bit hash for each token of a text."""
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def run_keys(hashes: Column, n: int) -> Column:
    """Array of the n-token runs of a column of token hashes, as (hash of the run, hash of its first token).

    128 bits stand for the text of a run, so no run is built as a string and the work is linear. The
    hashes have to be a stored column: an expression would be evaluated again for every run.
    """
    firsts = F.when(F.size(hashes) >= n, F.slice(hashes, F.lit(1), F.size(hashes) - (n - 1))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(firsts, lambda h, i: F.struct(F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, n)]).alias("run"), h.alias("first")))
