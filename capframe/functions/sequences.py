"""Token-id sequences: padding, loss masks, prefix trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capframe.fixed_values import IGNORED_LABEL, PAD_ID


def pad_right(ids: Column, length: Column | int, pad_id: int = PAD_ID) -> Column:
    """Ids followed by ``pad_id`` up to ``length``; longer lists stay as they are."""
    length = F.lit(length) if isinstance(length, int) else length
    missing = F.greatest(length - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_id), missing))


def mask_labels(ids: Column, pad_id: int | None, image_id: int | None, ignored: int = IGNORED_LABEL) -> Column:
    """Loss labels: the ids with padding and image places ignored; an unset special id masks nothing."""
    special = [i for i in (pad_id, image_id) if i is not None]
    if not special:
        return ids
    return F.transform(ids, lambda x: F.when(x.isin(special), F.lit(ignored)).otherwise(x))


def trim_prefix(output_ids: Column, input_ids: Column) -> Column:
    """Generated ids without the prompt they start with."""
    return F.slice(output_ids, F.size(input_ids) + 1, F.greatest(F.size(output_ids), F.lit(1)))
