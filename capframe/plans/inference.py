"""Batch inference with a user's model: caption completion and prompted classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capframe.fixed_values import CAPTION_PROMPT, CLASSES, SEED
from capframe.functions.prompts import (
    ChatTags,
    Templates,
    check_modalities,
    classification_prompt,
    inference_messages,
    render,
)
from capframe.functions.text import parse_label
from capframe.operators.captions import split_by_caption
from capframe.operators.ranking import shuffle_rows
from capframe.session import materialize

Model = Callable[[pd.DataFrame], Sequence]
Factory = Callable[[], Model]

CONFIGS = {"image_text": (True, True), "image": (True, False), "text": (False, True)}


def infer(factory: Factory, inputs: dict[str, Column], returns: str = "string", batch_size: int = 128) -> Column:
    """Outputs of a model as a column.

    ``factory()`` makes the model once per task. The model gets pandas frames of at most
    ``batch_size`` rows with the columns ``inputs`` and gives one output per row: a value, an array,
    or an array of arrays, as ``returns`` says. Outputs go back after every such batch, so wide ones
    never pile up. Only the inputs travel to the Python worker; other columns of the row stay where
    they are.
    """
    names = list(inputs)
    nested = T._parse_datatype_string(returns)
    rows = isinstance(nested, T.ArrayType) and isinstance(nested.elementType, T.ArrayType)
    flat = isinstance(nested, (T.StringType, T.ArrayType))

    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = factory()
        for series in batches:
            columns = series if isinstance(series, tuple) else (series,)
            frame = pd.concat(columns, axis=1, keys=names)
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size].reset_index(drop=True)
                outputs = [list(value) if rows and value is not None else value for value in model(part)]
                if len(outputs) != len(part):
                    raise ValueError(f"model gave {len(outputs)} outputs for {len(part)} rows")
                yield pd.Series(outputs, dtype=object if flat else None)

    # Nondeterministic: neither repeated nor moved by the optimizer, so each row is run once.
    return run.asNondeterministic()(*inputs.values())


def caption_prompt(image_path: Column, tags: ChatTags = ChatTags(), prompt: str = CAPTION_PROMPT) -> Column:
    return render(inference_messages(F.lit(prompt), image_path), tags, generation=True)


def complete_captions(
    photos: DataFrame,
    factory: Factory,
    tags: ChatTags = ChatTags(),
    prompt: str = CAPTION_PROMPT,
    seed: int = SEED,
    shuffle: bool = True,
) -> DataFrame:
    """Photos with their empty captions written by a model, in seeded random order.

    The model gets ``image_path`` and ``prompt``. Only rows without a caption reach it, and what it
    wrote is stored, so no later pass over the table runs it again.
    """
    missing, present = split_by_caption(photos)
    inputs = {"image_path": F.col("image_path"), "prompt": caption_prompt(F.col("image_path"), tags, prompt)}
    written = materialize(missing.withColumn("caption", infer(factory, inputs)), "completed")
    done = present.unionByName(written)
    return shuffle_rows(done, ["photo_id"], seed) if shuffle else done


def classification_inputs(
    photos: DataFrame, configs: Sequence[str], templates: Templates = Templates(), tags: ChatTags = ChatTags()
) -> DataFrame:
    """Photos once per configuration, with ``config``, ``prompt`` and the rendered ``request``.

    A configuration without images or captions sees null in their place.
    """
    for config in configs:
        check_modalities(*CONFIGS[config])
    with_image = [c for c in configs if CONFIGS[c][0]]
    with_text = [c for c in configs if CONFIGS[c][1]]
    repeated = photos.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs])))
    path = F.when(F.col("config").isin(*with_image), F.col("image_path"))
    caption = F.when(F.col("config").isin(*with_text), F.coalesce("caption", F.lit("")))
    prompted = repeated.withColumn("prompt", classification_prompt(path, caption, templates))
    messages = inference_messages(F.col("prompt"), path)
    return prompted.withColumn("request", render(messages, tags, generation=True))


def classify(
    photos: DataFrame,
    factory: Factory,
    configs: Sequence[str] = tuple(CONFIGS),
    labels: Sequence[str] = CLASSES,
    templates: Templates = Templates(),
    tags: ChatTags = ChatTags(),
) -> DataFrame:
    """``photo_id, label, config, output, pred``: all configurations in one job.

    The model gets ``image_path`` (null without images) and ``request``; its outputs are stored,
    so scoring does not run it again.
    """
    prompted = classification_inputs(photos, configs, templates, tags)
    path = F.when(F.col("config").isin(*[c for c in configs if CONFIGS[c][0]]), F.col("image_path"))
    answered = prompted.select(
        "photo_id", "label", "config", infer(factory, {"image_path": path, "request": F.col("request")}).alias("output")
    )
    return materialize(answered, "answers").withColumn("pred", parse_label(F.col("output"), labels))
