"""Training examples for caption models, and padded token batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capframe.fixed_values import BATCH_SIZE, CAPTION_PROMPT, IGNORED_LABEL, PAD_ID
from capframe.functions.prompts import MESSAGE_TYPE, ChatTags, generation_start, render, text_message, training_messages
from capframe.functions.sequences import mask_labels, pad_right
from capframe.operators.captions import drop_incomplete
from capframe.operators.ranking import with_batches
from capframe.session import materialize


def training_examples(photos: DataFrame, prompt: str = CAPTION_PROMPT) -> DataFrame:
    """``photo_id, messages, caption`` of the photos that have both path and caption."""
    complete = drop_incomplete(photos)
    messages = training_messages(F.col("image_path"), F.col("caption"), prompt)
    return complete.select("photo_id", messages.alias("messages"), "caption")


def padded_batches(
    df: DataFrame,
    ids: str,
    *order: str,
    size: int = BATCH_SIZE,
    pad_id: int | None = PAD_ID,
    image_id: int | None = None,
) -> DataFrame:
    """Rows in batches of ``size``, ``input_ids`` padded to the longest of the batch, masked ``labels``.

    The longest is found by an aggregate of one number per batch, written and joined back: its size
    is then known, and rows are not shuffled for it while it may be broadcast. Labels are masked
    before they are padded, as one long list makes padding most of its batch.
    """
    batched = with_batches(df.withColumn("_size", F.size(ids)), *order, size=size)
    longest = materialize(batched.groupBy("batch_id").agg(F.max("_size").alias("_longest")), "longest")
    pad = pad_id or PAD_ID
    masked_pad = IGNORED_LABEL if pad in (pad_id, image_id) else pad
    labels = mask_labels(F.col(ids), pad_id, image_id)
    padded = batched.join(longest, "batch_id")
    padded = padded.withColumn("input_ids", pad_right(F.col(ids), F.col("_longest"), pad))
    return padded.withColumn("labels", pad_right(labels, F.col("_longest"), masked_pad)).drop("_longest", "_size")


def rendered_conversations(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    tags: ChatTags = ChatTags(),
    generation: bool = False,
) -> DataFrame:
    """``key, rendered``: the turns of a conversation in order as one string, for training or, with
    ``generation``, up to where the answer begins. A null text is empty."""
    message = F.array(text_message(F.col(role), F.coalesce(text, F.lit("")))).cast(MESSAGE_TYPE)
    lines = turns.select(key, turn, render(message, tags).alias("_line"))
    whole = F.expr(f"listagg(_line, '') within group (order by {turn}, _line)")
    end = F.lit(generation_start(tags) if generation else "")
    return lines.groupBy(key).agg(whole.alias("_whole")).select(key, F.concat("_whole", end).alias("rendered"))
