"""Topics and titles as typed: prefixes, word stems, inflections, ranks against a query, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that inflect a noun, in the order they are tried, and prefixes that name no subject.
ENDINGS = ("en", "es", "n", "s", "e")
GENERIC_PREFIXES = ("thema", "sammlung", "themenseite", "kompendium", "titel", "topic")
# Licences by key.
LICENCES = {"CC_0": "CC0 1.0", "CC_BY": "CC BY", "CC_BY_SA": "CC BY-SA", "CC_BY_NC": "CC BY-NC", "CC_BY_ND": "CC BY-ND", "PDM": "Public Domain Mark"}


def without_prefix(topic: Column) -> Column:
    """A topic without a generic prefix such as `Thema: `."""
    plain = F.trim(F.regexp_replace(topic, r"\s+", " "))
    prefix = F.lower(F.trim(F.regexp_extract(plain, r"^\s*([A-Za-zÄÖÜäöüß][\wÄÖÜäöüß\- ]{1,30}?)\s*:\s*(.+)$", 1)))
    return F.when(prefix.isin(*GENERIC_PREFIXES), F.trim(F.regexp_replace(plain, r"^[^:]*:\s*", ""))).otherwise(plain)


def variants(topic: Column) -> Column:
    """The topic with an ending taken from its last word, if four letters stay."""
    last = F.element_at(F.split(topic, " "), -1)
    forms = [F.when(F.endswith(F.lower(last), F.lit(e)) & (F.length(last) - len(e) >= 4), F.substring(topic, F.lit(1), F.length(topic) - len(e))) for e in ENDINGS]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def stems(words: Column) -> Column:
    """Words of four letters and more, from six on without the last; a stem that begins with another one is dropped."""
    cut = F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 4), lambda w: F.when(F.length(w) >= 6, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))
    return F.filter(cut, lambda s: ~F.exists(cut, lambda o: (o != s) & F.startswith(s, o)))


def context_score(stems_: Column, title_words: Column, text_words: Column) -> Column:
    """Three for each stem that begins a word of the title, one for each that begins a word of the text."""
    begins = lambda ws, s: F.exists(ws, lambda w: F.startswith(w, s)).cast("int")
    return F.aggregate(stems_, F.lit(0), lambda n, s: n + 3 * begins(title_words, s) + begins(text_words, s))


def licence_label(key: Column, version: Column) -> Column:
    """The display name of a licence; only the CC BY family carries its version."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LICENCES.items() for x in pair]), key), key)
    return F.when((F.coalesce(version, F.lit("")) != "") & F.startswith(key, F.lit("CC_BY")), F.concat_ws(" ", name, version)).otherwise(name)


def resource_uri(title: Column, english: Column) -> Column:
    """The DBpedia resource of the English title, else of the German one; blanks become underscores."""
    base = F.when(english.isNotNull(), F.lit("http://dbpedia.org/resource/")).otherwise(F.lit("http://de.dbpedia.org/resource/"))
    name = F.translate(F.trim(F.coalesce(english, title)), " ", "_")
    for sign in '%"#<>?[]^`{|}\\':
        name = F.replace(name, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return F.concat(base, name)


def is_iri(value: Column) -> Column:
    """Whether a value is an http(s) IRI that cannot break out of angle brackets."""
    return F.rlike(value, F.lit(r"^https?://[^\s<>\"{}|\\^`\x00-\x20]*$"))
