"""From a topic to its articles: candidate titles in order, suggestions, the corpus of a topic, linked mentions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import archive as A
from tessella.operators import keys as K
from tessella.operators import mentions as M
from tessella.operators import topics as T

# Words that ask for an aspect of what stands behind them.
ASPECTS = "ursachen ursache aufbau folgen bedeutung entstehung entwicklung geschichte grundlagen merkmale arten".split()
GENITIVE = r"^(\S+)\s+(?:des|der|eines|einer|von)\s+(.+)$"
MOST_WORDS = 4


def nominative(phrase: Column) -> Column:
    """A genitive phrase with its adjectives in their basic form; the last word stays."""
    return F.regexp_replace(phrase, r"(?i)(\p{L}*e)n(?=\s)", "$1")


def compounds(head: Column, tail: Column) -> Column:
    """Compounds of one word behind the article with the word before it: `Kreis des Wassers` as Wasserkreis."""
    stems = F.concat(F.array(tail), F.transform(T.variants(tail), lambda s: s), F.transform(F.array(*[F.lit(e) for e in T.ENDINGS]), lambda e: F.when(F.endswith(F.lower(tail), e), F.substring(tail, F.lit(1), F.length(tail) - F.length(e)))))
    long = F.filter(F.array_distinct(F.array_compact(stems)), lambda s: F.length(s) >= 3)
    return F.when(F.contains(F.trim(tail), F.lit(" ")), F.array().cast("array<string>")).otherwise(F.transform(long, lambda s: F.concat(s, F.lower(head))))


def candidates(topic: Column) -> Column:
    """(method, title) in the order in which titles are tried: as asked, without an ending, the object of an aspect or the
    compound of a genitive."""
    entry = lambda method, titles: F.transform(titles, lambda t: F.struct(F.lit(method).alias("method"), t.alias("title")))
    head, tail = F.regexp_extract(topic, GENITIVE, 1), F.regexp_extract(topic, GENITIVE, 2)
    inner = nominative(tail)
    none = F.array().cast("array<string>")
    aspect = F.lower(head).isin(ASPECTS)
    return F.concat(
        entry("title", F.array(topic)),
        entry("variant", T.variants(topic)),
        entry("aspect", F.when((head != "") & aspect, F.concat(F.array(inner), T.variants(inner))).otherwise(none)),
        entry("compound", F.when((head != "") & ~aspect, compounds(head, tail)).otherwise(none)),
    )


def resolve(topics: DataFrame, key: str, titles: DataFrame, meanings: DataFrame | None = None, topic: str = "topic") -> DataFrame:
    """(key, title, method, confident): the article of each topic, null if there is none.

    titles has (title, is_disambiguation), one row a title; a topic's candidates meet it in one equi-join, and the
    first one that is a title counts. A page of meanings leads to the one that meanings (title, chosen) names. What no
    candidate finds takes the first suggestion that is an article, which is a guess.
    """
    offered = topics.select(key, topic, F.posexplode(candidates(F.col(topic))).alias("place", "c")).select(key, topic, "place", "c.method", "c.title")
    known = titles.select("title", "is_disambiguation")
    if meanings is None:
        known = known.withColumn("chosen", F.lit(None).cast("string"))
    else:
        known = known.join(meanings.select("title", "chosen"), "title", "left")
    hit = offered.join(known, "title").where(~F.col("is_disambiguation") | F.col("chosen").isNotNull())
    exact = K.keep_first(hit.select(key, "place", "method", "title", "chosen", "is_disambiguation"), [key], ["place"])
    method = F.when(F.col("is_disambiguation"), "disambiguation").when(F.col("method") == "aspect", "variant").otherwise(F.col("method"))
    exact = exact.select(key, F.when(F.col("is_disambiguation"), F.col("chosen")).otherwise(F.col("title")).alias("title"), method.alias("method"), F.col("method").isin("title", "variant").alias("confident"))
    open_ = topics.join(exact.select(key), key, "left_anti")
    guesses = A.suggestions(open_.select(F.col(topic).alias("prefix")), titles.where("NOT is_disambiguation").select("title"), n=1)
    guessed = open_.join(guesses, open_[topic] == guesses["prefix"], "left")
    guessed = guessed.select(key, "title", F.when(F.col("title").isNotNull(), "suggestion").alias("method"), F.lit(False).alias("confident"))
    return exact.unionByName(guessed)


def corpus(parts: list[tuple[str, DataFrame, int | None]], by: str, most: int) -> DataFrame:
    """(by, project, title, origin, place): the sources of each topic from its parts in order, each article once.

    A part is (origin, rows of (by, project, title, order), how many of them at most); a topic takes most sources in all. An
    article that two parts name belongs to the first.
    """
    rows = [df.select(by, "project", "title", "order", F.lit(i).alias("part"), F.lit(origin).alias("origin")) for i, (origin, df, _) in enumerate(parts)]
    all_ = reduce(DataFrame.unionByName, rows).withColumn("_t", F.lower("title"))
    # dealt before they are sorted, to so many tasks that each sorts little and that writing needs no sort (at most 200)
    dealt = all_.repartition(min(200, 16 * all_.sparkSession.sparkContext.defaultParallelism), by, "project", "_t")
    once = K.keep_first(dealt, [by, "project", "_t"], ["part", "order", "title"])
    given = [n if n is not None else most for _, _, n in parts]
    limits = F.create_map(*[x for i, n in enumerate(given) for x in (F.lit(i), F.lit(n))])
    in_part = F.row_number().over(Window.partitionBy(by, "part").orderBy("order", "title", "project"))
    # the plain limit lets tasks drop what cannot be among the first before it is shuffled
    kept = once.withColumn("_n", in_part).where(F.col("_n") <= max(given)).where(F.col("_n") <= F.element_at(limits, F.col("part")))
    place = F.row_number().over(Window.partitionBy(by).orderBy("part", "_n"))
    return kept.withColumn("place", place).where(F.col("place") <= most).select(by, "project", "title", "origin", "place")


def runs(text: Column, skip: list[str] | None = None) -> Column:
    """(text, start, end) of every run of up to MOST_WORDS words that begins with a capital letter; places count from 0."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_#-]+"), F.lit(0))
    between = F.split(text, r"[\p{L}\p{N}_#-]+")

    def starts(words: Column, gaps: Column) -> Column:
        """Where each word begins: what stands before it, gaps and words."""
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, i: F.struct((s["at"] + F.coalesce(F.length(F.get(gaps, i - 1)), F.lit(0)) + F.coalesce(F.length(F.get(words, i - 1)), F.lit(0))).alias("at"), F.concat(s["out"], F.array(s["at"] + F.coalesce(F.length(F.get(gaps, i - 1)), F.lit(0)))).alias("out")),
            lambda s: s["out"],
        )

    def of(words: Column, at: Column, i: Column) -> Column:
        last = F.sequence(i, F.least(i + MOST_WORDS - 1, F.size(words) - 1))
        return F.transform(last, lambda j: F.struct(F.substring(text, F.get(at, i) + 1, F.get(at, j) + F.length(F.get(words, j)) - F.get(at, i)).alias("text"), F.get(at, i).alias("start"), (F.get(at, j) + F.length(F.get(words, j))).alias("end")))

    def of_all(words: Column, at: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.rlike(F.coalesce(F.get(words, i), F.lit("")), F.lit(r"^\p{Lu}")) & ~F.lower(F.get(words, i)).isin(skip or [""]))
        return F.flatten(F.transform(first, lambda i: of(words, at, i)))

    return X.bound(found, lambda words: X.bound(between, lambda gaps: X.bound(starts(words, gaps), lambda at: of_all(words, at))))


def linked(texts: DataFrame, key: str, titles: DataFrame, text: str = "text") -> DataFrame:
    """(key, start, end, title): mentions of articles, longer ones first, none overlapping.

    A run is tried as it is and without a genitive ending; all of a text's runs meet the titles in one equi-join.
    """
    found = texts.select(key, F.explode(runs(F.col(text))).alias("r")).select(key, "r.*")
    bases = lambda t: F.array_compact(F.array(t, *[F.when(F.endswith(t, F.lit(e)) & (F.length(t) - len(e) >= 3), F.substring(t, F.lit(1), F.length(t) - len(e))) for e in ("es", "s")]))
    tried = found.select(key, "start", "end", F.posexplode(bases(F.col("text"))).alias("place", "title"))
    hit = K.keep_first(tried.join(titles.select("title").distinct(), "title"), [key, "start", "end"], ["place"]).drop("place")
    return M.without_overlaps(hit.withColumn("known", F.lit(True)), [key]).select(key, "start", "end", "title")


def _found(text: Column, pattern: Column) -> Column:
    """Where a pattern is first found, counted from 1; null if it is not."""
    return F.nullif(F.regexp_instr(text, pattern), F.lit(0))


def placed(text: Column, words: Column) -> Column:
    """(word, start) of named words in a text, longest first, none in the place of another; start is -1 if there is none.

    A whole word comes before a part of one, and of either the same case before any case.
    """
    quoted = lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    bound, end = F.lit(r"(?<![\p{L}\p{N}_])"), F.lit(r"(?![\p{L}\p{N}_])")
    free = F.lit("(?iu)")
    in_order = F.array_sort(F.array_distinct(words), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    start = F.struct(text.alias("rest"), F.array().cast("array<struct<word: string, start: int>>").alias("out"))

    def step(state: Column, w: Column) -> Column:
        rest = state["rest"]
        # a word that is nowhere in its own case is tried in any case only
        same = F.when(F.contains(rest, w), F.coalesce(_found(rest, F.concat(bound, quoted(w), end)), F.lit(0))).otherwise(0)
        any_case = lambda p: F.coalesce(_found(rest, F.concat(free, p)), F.lit(0))
        behind = lambda n: F.when(n != 0, n).when(F.contains(rest, w), F.coalesce(_found(rest, quoted(w)), F.lit(0))).otherwise(any_case(quoted(w)))
        place = X.bound(same, lambda n: F.when(n != 0, n).otherwise(X.bound(any_case(F.concat(bound, quoted(w), end)), behind)))

        def taken(at: Column) -> Column:
            hidden = F.when((at > 0) & (w != ""), F.overlay(rest, F.repeat(F.lit("\u0000"), F.length(w)), at, F.length(w))).otherwise(rest)
            return F.struct(hidden.alias("rest"), F.concat(state["out"], F.array(F.struct(w.alias("word"), F.when(w != "", at - 1).otherwise(-1).cast("int").alias("start")))).alias("out"))

        return X.bound(place, taken)

    return F.aggregate(in_order, start, step, lambda s: s["out"])


def article_of_material(title_article: Column, entities: Column, title: Column) -> Column:
    """The article that a material builds on: the title's, if its terms name it too; else the first term that the title names."""
    first = F.get(entities, F.lit(0))
    return F.when(F.array_contains(entities, title_article), title_article).when(F.contains(F.lower(title), F.lower(first)), first)


# How a sentence says that it defines, and what it then answers.
_TERM = r"([A-ZÄÖÜ][\p{L}\p{N}_-]*(?:\s+[A-ZÄÖÜ][\p{L}\p{N}_-]*)?)"
TEMPLATES = [
    (rf"^Als {_TERM} bezeichnet man(?![\p{{L}}\p{{N}}_])", "Definition", "Was bezeichnet man als $1?"),
    (rf"^{_TERM} nennt man(?![\p{{L}}\p{{N}}_])", "Definition", "Was nennt man $1?"),
    (rf"^Unter (?:dem Begriff )?{_TERM} versteht man(?![\p{{L}}\p{{N}}_])", "Definition", "Was versteht man unter $1?"),
    (rf"^{_TERM}\s+(?:ist|sind|war|waren)\s+(?:ein|eine|einer|der|die|das)(?![\p{{L}}\p{{N}}_])", "Definition", "Was versteht man unter $1?"),
    (r"^(.{3,60}?)\s+(?:besteht aus|gliedert sich in|umfasst)(?![\p{L}\p{N}_])", "Bestandteile", "Woraus besteht $1?"),
    (r"^(.{3,60}?)\s+(?:bestehen aus|gliedern sich in|umfassen)(?![\p{L}\p{N}_])", "Bestandteile", "Woraus bestehen $1?"),
    (r"^(.{3,60}?)\s+(?:dient|ermöglicht)(?![\p{L}\p{N}_])", "Zweck", "Wozu dient $1?"),
    (r"^(.{3,60}?)\s+(?:dienen|ermöglichen)(?![\p{L}\p{N}_])", "Zweck", "Wozu dienen $1?"),
]


def template_questions(sentence: Column) -> Column:
    """(kind, question) of each template that a sentence fits, one of each kind; an article that opens the subject is written small."""
    entries = []
    for pattern, kind, asked in TEMPLATES:
        subject = F.regexp_extract(sentence, pattern, 1)
        small = F.when(F.rlike(subject, F.lit("^(Der|Die|Das|Ein|Eine) ")), F.concat(F.lower(F.substring(subject, 1, 1)), F.substring(subject, F.lit(2), F.length(subject)))).otherwise(subject)
        before, after = asked.split("$1")
        entries.append(F.when(subject != "", F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(before), small, F.lit(after)).alias("question"))))
    found = F.array_compact(F.array(*entries))
    # of one kind the template that comes first
    return F.filter(found, lambda q, i: F.array_position(F.transform(found, lambda x: x["kind"]), q["kind"]) == i + 1)
