"""The policy that turns ranker scores into assignments: fixed scores for leads, weights for headings and sources.

All scores are whole millionths. The rules are one cascade of conditions on the chunk and slot table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scores that rules set, in millionths, and factors in per cent.
LEAD, TWIN_LEAD, SUBTOPIC_LEAD, LEXICON, CONFIDENT, LEAST = 2_000_000, 1_500_000, 900_000, 900_000, 650_000, 250_000
OTHER_HEADING, SECTION_LEAD, FIRST_SOURCE = 50, 130, 115


def score() -> Column:
    """The score of a chunk for a slot, from the columns of candidates(): see there."""
    role, lexicon = F.col("slot_role"), F.col("lexicon_slot")
    opening = (F.col("heading_level") == 0) & (F.col("position") == 0)
    secondary = ~F.col("is_primary")
    twin = (F.col("origin") == "same_topic") & opening
    defines = F.coalesce(F.col("lexicon_defines"), F.lit(False))
    subtopic = secondary & (F.col("origin") != "same_topic") & opening & F.col("title_has_topic")
    named = F.when(~(secondary & defines), lexicon)
    base = F.coalesce(F.col("fused"), F.lit(0))
    by_heading = F.when(named.isNull(), base).when(named == F.col("slot_key"), F.greatest(base, F.lit(LEXICON))).otherwise(base * OTHER_HEADING / 100)
    by_section = F.when((role == "systematik") & F.col("is_section_lead"), by_heading * SECTION_LEAD / 100).otherwise(by_heading)
    material = F.col("source_role") == "material"
    first = F.get("preference", F.lit(0))
    preferred = (F.col("project") == first) | material & (first == "wlo_material")
    by_source = F.when(F.coalesce(preferred, F.lit(False)), by_section * FIRST_SOURCE / 100).otherwise(by_section)
    wants = material & F.array_contains("preference", "wlo_material")
    ranked = F.when(F.coalesce(wants, F.lit(False)), CONFIDENT + (1_000_000 - CONFIDENT) * F.least(by_source, F.lit(1_000_000)) / 1_000_000).otherwise(by_source)
    fixed = (
        F.when(F.col("is_lead"), F.when(role == "definition", LEAD).otherwise(0))
        .when((role == "definition") & twin, TWIN_LEAD)
        .when((role == "definition") & (secondary | ~defines), 0)
        .when((role != "definition") & twin, 0)
        .when(subtopic, F.when(role == "systematik", SUBTOPIC_LEAD).otherwise(0))
    )
    return F.floor(F.coalesce(fixed.cast("double"), ranked.cast("double")) + 0.5).cast("long")


def candidates(chunks: DataFrame, slots: DataFrame, sources: DataFrame, fused: DataFrame) -> DataFrame:
    """Every chunk with every slot of its topic's template, its source and its ranker score.

    slots (slot_id, slot_order, slot_key, slot_role, preference) is a template, ten rows or so, and broadcast.
    """
    both = chunks.join(sources, ["topic", "source_id"]).crossJoin(F.broadcast(slots))
    return both.join(fused.select("topic", "chunk_id", "slot_id", F.col("score").alias("fused")), ["topic", "chunk_id", "slot_id"], "left")


def assign(candidates_: DataFrame, default_slot: str | None) -> DataFrame:
    """(topic, chunk_id, slot_id, score): the best slot of each chunk; what is not sure goes to the default slot
    if its source is on the topic, else nowhere. Ties keep the order of the template.
    """
    scored = candidates_.withColumn("score", score())
    best = scored.groupBy("topic", "chunk_id", "is_lead", "lexicon_slot", "topical").agg(F.max(F.struct("score", (-F.col("slot_order")).alias("o"), "slot_id")).alias("b"))
    sure = F.col("is_lead") | (F.col("lexicon_slot").isNotNull() & (F.col("b.score") >= LEXICON)) | (F.col("b.score") >= CONFIDENT)
    fallback = F.when(F.col("topical"), F.lit(default_slot))
    slot = F.when(sure, F.col("b.slot_id")).otherwise(fallback)
    return best.select("topic", "chunk_id", slot.alias("slot_id"), F.when(sure, F.col("b.score")).otherwise(F.lit(LEAST)).alias("score")).where("slot_id IS NOT NULL")
