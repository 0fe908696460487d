"""Prompts, chat messages and their rendering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from capframe.fixed_values import CAPTION_PROMPT, IMAGE_AND_TEXT_PROMPT, IMAGE_PROMPT, TEXT_PROMPT

MESSAGE_TYPE = (
    "array<struct<role:string,content:array<struct<type:string,image:string,text:string>>>>"
)


@dataclass(frozen=True)
class Templates:
    """Prompt per modality; ``{caption}`` marks the place of the caption."""

    image: str = IMAGE_PROMPT
    text: str = TEXT_PROMPT
    both: str = IMAGE_AND_TEXT_PROMPT


@dataclass(frozen=True)
class ChatTags:
    """How a model wants messages written; the values come with the model."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    image: str = "<|image|>"
    generation_role: str = "assistant"


def check_modalities(image: bool, text: bool) -> None:
    if not image and not text:
        raise ValueError("at least one of image and text is needed")


def fill(template: str, caption: Column) -> Column:
    """Template with the caption put in, taken literally."""
    return F.replace(F.lit(template), F.lit("{caption}"), caption)


def classification_prompt(image_path: Column, caption: Column, templates: Templates = Templates()) -> Column:
    """Prompt by which of path and caption is null; both null is an error."""
    no_image, no_text = image_path.isNull(), caption.isNull()
    return (
        F.when(no_image & no_text, F.raise_error(F.lit("neither image nor caption")).cast("string"))
        .when(no_image, fill(templates.text, caption))
        .when(no_text, F.lit(templates.image))
        .otherwise(fill(templates.both, caption))
    )


def _part(kind: str, value: Column) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"),
        (value if kind == "image" else empty).alias("image"),
        (value if kind == "text" else empty).alias("text"),
    )


def message(role: Column | str, *parts: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), F.array(*parts).alias("content"))


def text_message(role: Column | str, text: Column) -> Column:
    return message(role, _part("text", text))


def inference_messages(prompt: Column, image_path: Column) -> Column:
    """One user message: image and prompt, or the prompt alone where there is no image."""
    bare = F.array(text_message("user", prompt))
    full = F.array(message("user", _part("image", image_path), _part("text", prompt)))
    return F.when(image_path.isNull(), bare).otherwise(full).cast(MESSAGE_TYPE)


def training_messages(image_path: Column, caption: Column, prompt: str = CAPTION_PROMPT) -> Column:
    """User message with image and prompt, answered by the caption."""
    user = message("user", _part("image", image_path), _part("text", F.lit(prompt)))
    return F.array(user, text_message("assistant", caption)).cast(MESSAGE_TYPE)


def render(messages: Column, tags: ChatTags = ChatTags(), generation: bool = False) -> Column:
    """Messages as one prompt string; ``generation`` opens the answer (on for inference, off for training)."""
    def one(m: Column) -> Column:
        body = F.array_join(
            F.transform(m["content"], lambda p: F.when(p["type"] == "image", F.lit(tags.image)).otherwise(p["text"])),
            "",
        )
        return F.concat(F.lit(tags.start), m["role"], F.lit("\n"), body, F.lit(tags.end))

    text = F.array_join(F.transform(messages, one), "")
    return F.concat(text, F.lit(generation_start(tags))) if generation else text


def generation_start(tags: ChatTags = ChatTags()) -> str:
    """What opens the answer a model is to write."""
    return f"{tags.start}{tags.generation_role}\n"
