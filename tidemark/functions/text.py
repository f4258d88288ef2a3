"""Token and term functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import BRIDGE_TOO_COMMON, BRIDGE_TOPICLESS, COMMON_TECH_IDENTIFIERS, EVIDENCE_STOPWORDS, INFLECTIONS

ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"
TOKEN = r"[\p{L}\p{N}]+"
WORD = r"[A-Za-z][A-Za-z0-9]*(?:[_.:-][A-Za-z0-9]+)*|[一-鿿]{2,}"
WHOLE_TERM = r"[A-Za-z][A-Za-z0-9_.:-]+|[一-鿿]{2,}"
COMPOSITE = r"[A-Za-z][A-Za-z0-9]*(?:[-._:][A-Za-z0-9]+)+"
HAN = r"[一-鿿]+"


def fold(text: Column) -> Column:
    """Lower case without the accents of Western European letters, as the full-text index folds them."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Index tokens in order: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def grams(span: Column, n: int) -> Column:
    """All substrings of n characters of a span, in order."""
    return F.when(F.char_length(span) >= n, F.transform(F.sequence(F.lit(1), F.char_length(span) - n + 1), lambda i: F.substr(span, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def cjk_ngrams(text: Column) -> Column:
    """All 2- and 3-grams of Han runs, first seen first."""
    spans = F.regexp_extract_all(text, F.lit(r"[一-鿿]{2,}"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.concat(grams(s, 2), grams(s, 3)))))


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_word(word: Column) -> Column:
    # a map is searched entry by entry, a set is not: only words that the map has are looked up in it
    table = F.create_map(*[F.lit(x) for pair in INFLECTIONS.items() for x in pair])
    return F.when(casefold(word).isin(*INFLECTIONS), F.try_element_at(table, casefold(word))).otherwise(casefold(word))


def _with_bigrams(found: Column) -> Column:
    """Each term, and the 2-grams of those that are Han runs of three characters or more."""
    return F.flatten(F.transform(found, lambda w: F.when(w.rlike(f"^{HAN}$") & (F.char_length(w) > 2), F.concat(F.array(w), grams(w, 2))).otherwise(F.array(w))))


def evidence_terms(text: Column) -> Column:
    """Distinct terms that can carry evidence: inflections undone, stop words and numbers left out."""
    found = F.transform(F.array_distinct(words(F.coalesce(text, F.lit("")))), normalize_word)
    kept = F.filter(found, lambda w: ~w.isin(*EVIDENCE_STOPWORDS) & ~w.rlike("^[0-9]+$"))
    return F.array_distinct(_with_bigrams(kept))


def whole_terms(text: Column) -> Column:
    found = F.transform(F.filter(words(F.coalesce(text, F.lit("")), WHOLE_TERM), lambda w: ~F.lower(w).isin(*BRIDGE_TOPICLESS)), F.lower)
    return F.array_distinct(_with_bigrams(found))


def bridge_terms(title: Column, search_terms: Column) -> Column:
    """Terms that may connect vocabularies: of title and search terms, 2 to 24 characters, without a second stop list."""
    found = whole_terms(F.concat_ws(" ", title, search_terms))
    return F.filter(found, lambda w: F.char_length(w).between(2, 24) & ~w.isin(*BRIDGE_TOO_COMMON))


def composite_identifiers(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text, COMPOSITE), F.lower))


def distinctive_identifiers(text: Column) -> Column:
    """Names that can carry recall alone: composite, acronym of 3 to 16, or with two capitals; common protocols are not."""
    ascii_words = F.filter(F.array_distinct(words(F.coalesce(text, F.lit("")))), lambda w: w.rlike("^[ -~]+$"))

    def distinctive(w: Column) -> Column:
        upper = F.char_length(F.regexp_replace(w, "[^A-Z]", ""))
        acronym = w.rlike("[A-Z]") & ~w.rlike("[a-z]") & F.char_length(w).between(3, 16)
        return ~F.lower(w).isin(*COMMON_TECH_IDENTIFIERS) & (w.rlike(r"[_.:-]|[0-9]") | acronym | (upper >= 2))

    return F.array_distinct(F.transform(F.filter(ascii_words, distinctive), F.lower))


def redact(text: Column) -> Column:
    """Secrets out of transcripts: key-value pairs, bearer tokens and key-shaped strings."""
    from .tables import REDACTIONS

    out = text
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def query_hash(query: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(casefold(query), r"\s+", " ")), 256)


def record_digest(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\x1f"), content), 256)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


#: Ways to speak of the theme of pages, which are one for queries.
THEME_TALK, THEME = "视觉习惯|常用风格|页面颜色|清爽配色|默认视觉", "页面主题"


def query_tokens(query: Column, limit: int = 64) -> Column:
    """Tokens that a query is matched by: up to 24 words, concept markers, aliases, further words, Han grams; at most 64."""
    from .concepts import aliases, markers

    query = F.regexp_replace(query, THEME_TALK, THEME)
    raw = words(query)
    named = F.array_distinct(F.flatten(F.transform(raw, lambda w: F.array(normalize_word(w), w))))
    head, tail = F.slice(named, 1, 24), F.slice(named, 25, 10_000)
    return F.slice(F.array_distinct(F.concat(head, markers(query), aliases(query), tail, cjk_ngrams(query))), 1, limit)


def index_terms(token: Column) -> Column:
    """A query token as the index knows it: its index tokens in a row, parted by spaces; a phrase if there are several."""
    return F.array_join(tokens(token), " ")


def indexed_text(title: Column, content: Column, search_terms: Column) -> Column:
    """What a record is indexed by: its texts, the markers of its concepts, its Han grams and inflections undone."""
    from .concepts import markers

    text = F.concat_ws(" ", title, search_terms, content)
    inflected = F.filter(F.array_distinct(words(text)), lambda w: (normalize_word(w) != casefold(w)) & w.rlike("^[ -~]+$"))
    undone = F.array_distinct(F.transform(inflected, normalize_word))
    more = F.array_distinct(F.concat(markers(text, None), cjk_ngrams(text), undone))
    return F.concat_ws("\n", title, content, search_terms, F.array_join(more, " "))


def sentence_units(text: Column) -> Column:
    """Sentences of a text: parted at Han stops, line ends, and Western stops that white space follows."""
    return F.filter(F.transform(F.split(text, r"[。！？\n]|(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda u: u != "")
