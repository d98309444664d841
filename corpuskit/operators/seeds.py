"""Seed texts: template fills, deduplication, continued ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.hashing import pick_index
from corpuskit.functions.text import hash_uuid
from corpuskit.operators.ranking import global_position


def fill_templates(slots: DataFrame, key: str, templates: Sequence[str], fillers: Mapping[str, Sequence[str]], seed: int) -> DataFrame:
    """Adds ``text``: a template chosen by hash of the key, each ``{name}`` in it by a value chosen likewise."""

    def choose(values: Sequence[str], name: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (pick_index(F.lit(len(values)), f"{seed}:{name}", key) + 1).cast("int"))

    text = choose(templates, "template")
    for name, values in fillers.items():
        text = F.replace(text, F.lit("{" + name + "}"), choose(values, name))
    return slots.withColumn("text", text)


def distinct_texts(df: DataFrame, order: str, text: str = "text", cap: int | None = None) -> DataFrame:
    """``position, text, <order>``: each text once, in the order of its first row; with ``cap`` the first so many."""
    once = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(order).alias(order))
    out = global_position(once, [order, text], "position")
    return out if cap is None else out.where(F.col("position") < cap)


def continue_seeds(old: DataFrame, new: DataFrame, seed: int, source: str) -> DataFrame:
    """Old seeds and new texts; the new ones get ids from the old maximum on, and uuids from their id and text."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = new.withColumn("id", (F.col("position") + F.lit(top + 1)).cast("int")).withColumn("uuid", hash_uuid(seed, F.col("id"), F.col("text"))).withColumn("source", F.lit(source))
    return old.unionByName(added.select(*old.columns))
