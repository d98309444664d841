"""Normal form of speaker ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for "no speaker" after normalisation.
UNKNOWN_IDS = ("", "__null_ref__", "__null__")
UNKNOWN_PATTERN = "^[0-9a-f]{4}_none$"


def speaker_normal_form(speaker: Column | str) -> Column:
    """Blanks and tabs trimmed, lower case, each run of blanks, tabs and hyphens one ``_``; null stays null."""
    c = F.col(speaker) if isinstance(speaker, str) else speaker
    return F.regexp_replace(F.lower(F.trim(c, F.lit(" \t"))), "[ \t-]+", "_")


def known_speaker(speaker: Column | str) -> Column:
    """The normal form, or null where the id names nobody."""
    form = speaker_normal_form(speaker)
    return F.when(~form.isin(*UNKNOWN_IDS) & ~form.rlike(UNKNOWN_PATTERN), form)
