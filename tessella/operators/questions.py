"""What a question names: the words and groups of words under which its article may be found, in its order.

A text is worked off by itself, in Python: of a run of n capitalised words there are n * n / 2 names and more, which are slices
of the run there, while array functions take a step of an interpreter for each of their words. Nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.functions import text as X

# Words that ask or join, and words for a kind of question or a class of things.
FUNCTION = """
wie was warum wieso weshalb weswegen welche welcher welches welchen welchem wer wen wem wessen wo woher wohin
wann womit wozu wodurch erkläre erklärt beschreibe nenne zeige die der das den dem des ein eine einen einem eines
und oder für mit bei beim im in am an auf aus von vom zum zur zu über unter nach vor gegen ohne um es man sich
sie er wir ihr unser unsere unserer einfach dagegen kann können ist sind war waren hat haben zwischen neben
hinter wegen oben unten innen außen eben gerne heute lange immer jede jeder jedes jeden jedem diese dieser
dieses diesen diesem alle allen aller viele vielen einige einigen andere anderen ich mich mir mein meine
meiner meinem meinen du dich dir dein deine deiner
""".split()
GENERIC = """
unterschied unterschiede ursache ursachen rolle beispiel beispiele folge folgen gefahren gefahr chancen chance
entstehung bedeutung klasse klassen schüler schülerinnen unterricht thema frage teil art arten grundlagen
überblick einführung funktion funktionsweise aufbau entwicklung vergleich zusammenhang möglichkeiten vorteile
nachteile grundschule sekundarstufe jugendliche kinder aufgabe aufgaben tiere pflanzen menschen lebewesen länder
stoffe dinge leute personen regeln gründe grund probleme problem eigenschaften merkmale formen methoden
erfindung
""".split()
DECLENSIONS, BASIC, NOUN_ENDINGS = ("en", "em", "er", "es", "e"), ("e", "er", "es"), ("es", "s", "e", "en", "n")
#: Letters that a noun keeps without its ending, and an adjective; keywords of one question that are looked up.
NOUN_STEM, ADJECTIVE_STEM, MOST = 4, 3, 50
#: Signs of the keywords that leave Python at once.
TOGETHER = 1 << 21
_NO_NAMES = frozenset(FUNCTION + GENERIC)
_WORDS = re.compile("[A-Za-zÄÖÜäöüßẞ\u212a-]+")


def noun_forms(noun: str) -> list[str]:
    """The noun, and what is left without each ending that it may have by a case or a plural."""
    return list(dict.fromkeys([noun, *(noun[: -len(e)] for e in NOUN_ENDINGS if noun.endswith(e) and len(noun) - len(e) >= NOUN_STEM)]))


def adjective_forms(adjective: str) -> list[str]:
    """A declined adjective as titles have it, with a capital."""
    lower = adjective.lower()
    stem = next((adjective[: -len(e)] for e in DECLENSIONS if lower.endswith(e) and len(adjective) - len(e) >= ADJECTIVE_STEM), adjective)
    return [stem[:1].upper() + stem[1:] + e for e in BASIC]


def _content(word: str) -> bool:
    return word[:1].isupper() and word.lower() not in _NO_NAMES


class _Runs:
    """The rests of runs of a text, in the order in which they are met, as a tree by words: how much of one an earlier one begins with.

    A rest that is told apart by its first words has a leaf with its place; leaves are parted when another rest comes to them.
    """

    def __init__(self, words: list[str], ends: list[int]) -> None:
        self.words, self.ends, self.root = words, ends, {}

    def met(self, at: int) -> tuple[int, list[str]]:
        """How many words of the rest at a place an earlier one begins with, and the words that earlier ones have behind these."""
        words, end, node, place = self.words, self.ends[at], self.root, at
        while place < end:
            there = node.get(words[place])
            if there is None:
                behind = list(node)
                node[words[place]] = at
                return place - at, behind
            if isinstance(there, int):
                next_ = there + place - at + 1
                there = node[words[place]] = {words[next_]: there} if next_ < self.ends[there] else {}
            node, place = there, place + 1
        return place - at, []


def named(text: str) -> Iterator[list[str]]:
    """The keywords of a text in order, each once, as lists: those of one word longest first.

    At a word there may begin a pair with `und`, an adjective with its noun, a run of capitalised words, and the noun by itself.
    Of a name of three and more words of a run it is known from the tree of runs whether it was there before, so only shorter ones are kept in mind.
    """
    words = _WORDS.findall(text)
    n, seen = len(words), set()
    content = [_content(w) for w in words]
    forms: dict[str, list[str]] = {w: noun_forms(w) for w, c in zip(words, content, strict=True) if c}
    # where the run ends that goes on at a word
    ends = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        ends[i] = (ends[i + 1] if i + 1 < n and (content[i + 1] or words[i + 1] == "von") else i + 1) if content[i] or words[i] == "von" else i
    runs, run_end = _Runs(words, ends), -1

    def new(found: list[str]) -> list[str]:
        found = [k for k in dict.fromkeys(found) if k not in seen]
        seen.update(found)
        return found

    for i, word in enumerate(words):
        following, follows = (words[i + 1], content[i + 1]) if i + 1 < n else ("", False)
        if not content[i]:
            if follows and word[:1].islower() and word not in FUNCTION and len(word) > NOUN_STEM and word.endswith(DECLENSIONS):
                yield new([f"{a} {f}" for a in adjective_forms(word) for f in forms[following]])
            continue
        if following == "und" and i + 2 < n and content[i + 2]:
            yield new([f"{word} und {words[i + 2]}"])
        end = ends[i]
        if end - i >= 3:
            if end != run_end:
                # the run as one text, where its words begin, and where the forms of its nouns end, the last noun's first
                run_end, run, starts, stops, first = end, " ".join(words[i:end]), {}, [], {}
                begin = 0
                for j in range(i, end):
                    starts[j], begin = begin, begin + len(words[j]) + 1
                for j in range(end - 1, i, -1):
                    first[j] = len(stops)
                    if words[j] != "von":
                        stops += [starts[j] + len(f) for f in forms[words[j]]]
                first[i] = len(stops)
            known, behind = runs.met(i)
            a = starts[i]
            # names of known + 2 words and more are new, those of known + 1 but for the forms that others share, shorter ones are not
            shortest = max(i + known + 1, i + 2)
            some = first[shortest - 1] if shortest < end else 0
            step = max(1, TOGETHER // len(run))
            for c in range(0, some, step):
                yield [run[a:b] for b in stops[c : min(c + step, some)]]
            if known >= 2 and i + known < end and words[i + known] != "von":
                before = {f for w in behind if w != "von" for f in forms[w]}
                head = run[a : starts[i + known]]
                yield [head + f for f in forms[words[i + known]] if f not in before]
        if end - i >= 2 and following != "von":
            pair = [f"{word} {f}" for f in forms[following]]
            if word.lower().endswith(DECLENSIONS):
                pair += [f"{a} {f}" for a in adjective_forms(word) for f in forms[following]]
            yield new(pair)
        yield new(forms[word])


def keywords(texts: DataFrame, by: str, text: str = "text", most: int | None = MOST) -> DataFrame:
    """Rows (by, place, keyword) of texts that by tells apart: the keywords of each text in order, each once; with most, only the first ones of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rows, counts, places, found, signs = -1, [], [], [], [], 0

            def batched() -> pa.RecordBatch:
                of = np.repeat(np.array(rows, np.int64), counts)
                place = np.concatenate([np.arange(a, a + n, dtype=np.int32) for a, n in zip(places, counts, strict=True)])
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(place), pa.array(found, pa.string())], names=[by, "place", "keyword"])  # noqa: B023

            for part in X.pieces(batch.column(1)):
                for value in part.to_pylist():
                    row, place = row + 1, 0
                    for some in named(value) if value is not None else ():
                        if most is not None:
                            some = some[: most - place]
                        if some:
                            rows.append(row), counts.append(len(some)), places.append(place)
                            found += some
                            place, signs = place + len(some), signs + sum(map(len, some))
                        if signs >= TOGETHER:
                            yield batched()
                            rows, counts, places, found, signs = [], [], [], [], 0
                        if place == most:
                            break
            if found:
                yield batched()

    return texts.select(by, text).mapInArrow(run, f"`{by}` {texts.schema[by].dataType.simpleString()}, place int, keyword string")
