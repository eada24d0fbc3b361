"""Column functions over text: words, stems, fingerprints, cleaning. No UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that Python takes out of an Arrow batch at a time.
PIECE = 1 << 20

# The German function words that the word splitter drops.
STOP_WORDS = """
der die das des dem den ein eine einer eines einem einen und oder aber auch als bei mit ohne von vom zu zum zur
für fuer im in ins an am auf aus nach über unter vor durch gegen um bis seit wird werden wurde wurden ist sind war
waren sein hat haben hatte hatten kann können konnte nicht nur noch sich so wie was wer wo dass ob es er sie wir ihr
man diese dieser dieses diesen jene alle allen alles andere anderen mehr sehr etwa z b zb bzw sowie dabei dazu
daher dann dort hier heute schon bereits sowohl weder noch zwischen während wegen trotz statt keine keinen reine
reinen baustein bausteine siehe
""".split()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often use names it; a plain column inside a lambda is worked out anew each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words of over two signs that are no stop words, in order, with repeats."""
    stop = list(dict.fromkeys(STOP_WORDS if stop_words is None else stop_words))
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zäöüß0-9]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def padded_grams(text: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams inside each blank-padded word; a word shorter than a size counts once, as it is.

    Sizes go up, and a word that is no longer than a size gives no gram of the sizes above it.
    """
    padded = F.transform(F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(word: Column, n: int, shortest: bool) -> Column:
        whole = F.array(word) if shortest else F.array().cast("array<string>")
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
        return F.when(F.length(word) >= n, F.transform(starts, lambda s: F.substring(word, s, F.lit(n)))).otherwise(whole)

    def of_word(word: Column) -> Column:
        return F.concat(*[of_size(word, n, i == 0) for i, n in enumerate(sizes)])

    return F.flatten(F.transform(padded, of_word))


def collapsed(text: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def text_hash(text: Column) -> Column:
    """Sixteen hex digits that tell paragraphs apart regardless of case and white space."""
    return F.substring(F.sha1(F.lower(collapsed(text))), 1, 16)


def stem(word: Column) -> Column:
    """Words of five letters and more lose their last letter."""
    return F.when(F.length(word) >= 5, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def scaled(value: Column) -> Column:
    """A number in millionths, rounded half up, as a whole number: sums of these do not depend on order."""
    return F.floor(value * 1e6 + 0.5).cast("long")


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[pa.Array]:
    """A column of texts in parts of about as many bytes, a longer text by itself: Python then holds one part, not a whole batch."""
    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.append(0, np.flatnonzero(np.diff(ends // most)) + 1)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(column)], strict=True):
        yield column.slice(a, b - a)


def is_boilerplate(text: Column) -> Column:
    """Paragraphs that point elsewhere or speak of the article: list signs, arrows, see-also lines."""
    # Openings of pointers.
    return F.rlike(F.trim(text), F.lit(r"^(↑|\^|\[↑\]|→|(?i:siehe auch:|hauptartikel:))"))


def is_fragment(text: Column) -> Column:
    """Introductions of formulas, captions, and figure references."""
    trimmed = F.trim(text)
    unended = (F.length(trimmed) < 100) & ~F.rlike(trimmed, F.lit('[.!?“")]$'))
    return F.endswith(trimmed, F.lit(":")) | unended | F.rlike(trimmed, F.lit(r"^(?i:(in|im) (figur|bild|abbildung|grafik|tabelle|diagramm))(?![\p{L}\p{N}_])"))


def is_free(licence: Column) -> Column:
    """Public domain, CC BY and CC BY-SA, in any version."""
    return F.rlike(F.trim(licence), F.lit(r"^(CC0 1\.0|Public Domain Mark|CC BY(-SA)?( \d(\.\d)?)?)$"))


def token_estimate(text: Column) -> Column:
    """A bound of tokens: a third of the narrow signs, each sign from U+0800 on, and one."""
    wide = F.length(F.regexp_replace(text, r"[^\x{800}-\x{10FFFF}]", ""))
    return F.floor((F.length(text) - wide) / 3) + wide + 1


#: Signs that a facet marker may not hold, and their codes; % comes first.
MARKER_CODES = {"%": "%25", ";": "%3B", "=": "%3D", "|": "%7C", "<": "%3C", ">": "%3E", '"': "%22"}


def marker_encoded(text: Column) -> Column:
    for sign, code in MARKER_CODES.items():
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def marker_decoded(text: Column) -> Column:
    for sign, code in reversed(MARKER_CODES.items()):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text without overlap."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, F.floor(gone / F.length(part))).otherwise(0).cast("long")
