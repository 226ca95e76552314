"""Expressions over token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civitext.schemas import EOS_ID, PAD_ID, START_ID


def append_eos(ids: Column) -> Column:
    return F.concat(ids, F.array(F.lit(EOS_ID)))


def frame(ids: Column) -> Column:
    return F.concat(F.array(F.lit(START_ID)), ids, F.array(F.lit(EOS_ID)))


def truncate(ids: Column, length: int, force_eos: bool = False) -> Column:
    """First `length` ids; `force_eos` puts the end mark last in a cut sequence."""
    cut = F.slice(ids, 1, length)
    if not force_eos:
        return cut
    forced = F.concat(F.slice(ids, 1, length - 1), F.array(F.lit(EOS_ID)))
    return F.when(F.size(ids) > length, forced).otherwise(cut)


def pad(ids: Column, length: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.greatest(length - F.size(ids), F.lit(0))))


def fixed_length(ids: Column, length: int, force_eos: bool = False) -> Column:
    return pad(truncate(ids, length, force_eos), length)


def nonpad_length(ids: Column) -> Column:
    return F.size(F.array_remove(ids, PAD_ID))


def shift_inputs(ids: Column) -> Column:
    """All ids but the last."""
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def shift_targets(ids: Column) -> Column:
    """All ids but the first."""
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def until_eos(ids: Column) -> Column:
    """Ids before the first end mark, all of them if there is none."""
    at = F.array_position(ids, EOS_ID).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at - 1)).otherwise(ids)


def ids_to_text(ids: Column) -> Column:
    return F.concat_ws(" ", ids.cast("array<string>"))


def text_to_ids(text: Column) -> Column:
    return F.array_remove(F.split(text, " +"), "").cast("array<int>")
