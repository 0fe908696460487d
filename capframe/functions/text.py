"""Caption text: paths, tokens, white space, label parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from capframe.fixed_values import CLASSES, MAX_LEN, TOKEN_PATTERN

# Word characters and white space as Python's ``re`` and ``str.strip`` see them.
WORD_CHAR = r"[\p{L}\p{N}_]"
BLANK = r"[\s\x1c-\x1f]"

# Lower-cased text up to the end of the n-th token. Possessive, so it is read once from the left.
HEAD_PATTERN = r"^(?:[^a-z.,!?;:()\-']*+(?:[a-z]++|[.,!?;:()\-'])){0,%d}+"
_NESTED = 64  # the matcher nests once per token of the head, so longer heads are not searched
_LONG = 32  # characters per token kept, beyond which finding the head first pays


def image_path(photo_id: Column, folder: str, suffix: str = ".jpg") -> Column:
    """Path of a photo: folder + id + suffix."""
    return F.concat(F.lit(folder), photo_id.cast("string"), F.lit(suffix))


def tokenize(caption: Column, max_len: int | None = MAX_LEN) -> Column:
    """Lower-cased words and punctuation marks, the first ``max_len`` of them; null gives an empty list.

    With a limit, the scan of a long text ends at the last token kept: the tokens that follow
    cannot change the ones before them.
    """
    text = F.lower(F.coalesce(caption, F.lit("")))
    if max_len is None:
        return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    if max_len <= _NESTED:
        head = F.regexp_extract(text, HEAD_PATTERN % max_len, 0)
        text = F.when(F.length(text) > _LONG * max_len, head).otherwise(text)
    return F.slice(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), 1, max_len)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def _without_shared_starts(labels: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Groups of labels in which none starts like another: at one place only one of a group can occur."""
    groups: list[list[tuple[str, str]]] = []
    for label in labels:
        for group in groups:
            if not any(label[0].startswith(o[0]) or o[0].startswith(label[0]) for o in group):
                group.append(label)
                break
        else:
            groups.append([label])
    return groups


def parse_label(output: Column, labels: Sequence[str] = CLASSES) -> Column:
    """First label of the list that occurs as a whole word in a model output, else the stripped output.

    One scan of the output finds the labels in it; the order of the list then decides. Labels are
    matched as they are, inside a look-ahead, so that one may start within another: at each place
    the scan notes the label that comes first in the list, and shorter ones have a group of their own.
    """
    quoted = [rf"\Q{label}\E" for label in labels]
    starts = "".join(sorted({rf"\x{{{ord(label[0]):x}}}" for label in labels}))
    scans = []
    for group in _without_shared_starts(list(zip(labels, quoted))):
        pattern = rf"(?=[{starts}])(?<!{WORD_CHAR})(?=({'|'.join(q for _, q in group)})(?!{WORD_CHAR}))"
        scans.append(F.regexp_extract_all(F.lower(output), F.lit(pattern), F.lit(1)))
    found = scans[0] if len(scans) == 1 else F.concat(*scans)
    listed = F.array(*[F.lit(label) for label in labels])
    return F.coalesce(F.get(F.array_intersect(listed, found), F.lit(0)), strip(output))


def is_missing(caption: Column) -> Column:
    """True for the empty caption only; blanks and nulls count as captions."""
    return caption.eqNullSafe(F.lit(""))
