"""Diagnosis labels, subject ids and speakers as they come, made canonical."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import present, strip, sub

UNKNOWN = "Unknown"
# The tokens of each canonical label, and what stands for a missing subject id.
TOKENS = {
    "AD": ("AD", "PROBABLEAD", "POSSIBLEAD"),
    "HC": ("HC", "NC", "CN", "CTRL", "CONTROL", "CONTROLS", "HEALTHY", "NORMAL"),
    "MCI": ("MCI", "MILDCOGNITIVEIMPAIRMENT"),
}
NO_ID = ("", "nan", "none", "null")


def label_token(raw: Column) -> Column:
    """Upper case, letters A-Z and digits alone."""
    return F.regexp_replace(F.upper(strip(present(raw))), "[^A-Z0-9]+", "")


def canonical(raw: Column) -> Column:
    """AD, HC or MCI; null where the label isn't known."""
    token, out = label_token(raw), F.lit(None).cast("string")
    for label, tokens in reversed(TOKENS.items()):
        out = F.when(token.isin(*tokens), F.lit(label)).otherwise(out)
    return out


def canonical_strict(raw: Column) -> Column:
    """The same, but an unknown label fails the job."""
    return F.coalesce(canonical(raw), F.raise_error(F.concat(F.lit("unknown diagnosis label: "), present(raw))).cast("string"))


def mapped(raw: Column, table: Mapping[str, str] | None = None) -> Column:
    """Through ``table`` (its keys compared as tokens), then canonical; ``Unknown`` where that fails."""
    token, source = label_token(raw), raw
    for key, value in (table or {}).items():
        own = "".join(c for c in key.strip().upper() if c.isascii() and c.isalnum())
        source = F.when(token == own, F.lit(value)).otherwise(source)
    return F.coalesce(canonical(source), F.lit(UNKNOWN))


def subject_id(raw: Column) -> Column:
    """Stripped; null where it says that there is none."""
    value = strip(present(raw))
    return F.when(~F.lower(value).isin(*NO_ID), value)


def speaker(raw: Column) -> Column:
    """Without angle brackets and white space around."""
    return strip(sub(strip(present(raw)), "^[<>]+|[<>]+$", ""))


def binary(label: Column) -> Column:
    """HC: 0, AD: 1, others null."""
    value = strip(present(label))
    return F.when(value == "HC", 0).when(value == "AD", 1)


def sample_id(label: Column, stem: Column) -> Column:
    """The stem, after its label unless it begins with that."""
    label = F.upper(strip(label))
    head = F.concat(label, F.lit("_"))
    return F.when(F.startswith(F.upper(stem), head), stem).otherwise(F.concat(head, stem))
