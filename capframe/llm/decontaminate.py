"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts become templates: numbers, units after numbers, and names (runs of capitalised words, those at
the start of a sentence apart from others) are replaced by typed placeholders. Windows of template
tokens are hash-joined; a document and an item that share most of the item's windows are then checked
for consistent slots: along a run of alignments, one value of the item must always meet one value of
the document and the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capframe.llm.common import materialize

WINDOW = 5
SHARE = 0.6  # of an item's windows
CONSISTENT = 0.8  # of the slots on aligned windows
ITEM_WINDOWS = 1_000_000  # broadcast up to here, shuffled beyond
PAIR = ["doc_id", "item_id"]
RUN = [*PAIR, "kind", "run"]

UNITS = (
    "mm cm m km kg g mg lb oz l ml s ms min h hr hrs hour hours day days week weeks month months year years "
    "mile miles meter meters metre metres euro euros dollar dollars cent cents percent usd eur"
).split()
_NUMBER = r"\d+(?:[.,]\d+)*"
_CAPITAL = r"\p{Lu}\p{Ll}+"
NAME_WORDS = 4  # capitalised words in a row that can be one name


def marked_tokens(text: Column) -> Column:
    """Lower-case tokens; units start with ``_u``, names with ``_n`` or ``_s``, numbers with a digit.

    A number with its points and commas is one token, and so is a name of several words. ``_n``
    names stand in mid-sentence, ``_s`` ones elsewhere, as at the start of a sentence or text, where
    any word has a capital. More than ``NAME_WORDS`` capitalised words in a row are a title, kept as words.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[_\x{0}\x{1}]+", " ")
    # Title words get a mark that ends with the split; the rest of the patterns pass them by. Patterns
    # begin with what is rare in a text, a space or a capital, and look back from there.
    row = rf"(?:{_CAPITAL} ){{{NAME_WORDS}}}\p{{Lu}}\p{{Ll}}"
    long_run = rf"(?<![\p{{L}}\p{{N}}])(?={row})"
    marked = F.regexp_replace(plain, rf"(?:{long_run}|(?!^)\G( ))({_CAPITAL})", "$1\x01$2")
    titles = F.when(plain.rlike(row), marked).otherwise(plain)
    joined = F.regexp_replace(titles, rf"({_CAPITAL}) (?=\p{{Lu}}\p{{Ll}})", "$1_")
    names = F.regexp_replace(joined, r" (?=\p{Lu}\p{Ll})(?<=[\p{Ll},;] )", " _n")
    names = F.regexp_replace(names, r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{N}_\x{1}])", "_s")
    units = F.regexp_replace(names, rf"({_NUMBER}) ?({'|'.join(UNITS)})\b", r"$1 _u$2 ")
    numbers = F.regexp_replace(units, r"(?<=\d)[.,](?=\d)", "_")
    return F.filter(F.split(F.lower(numbers), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def template_hash(token: Column) -> Column:
    """Hash of a marked token with its value taken out."""
    open_ = F.when(token.startswith("_"), F.substring(token, 1, 2)).when(F.ascii(token).between(48, 57), F.lit("0"))
    return F.xxhash64(open_.otherwise(token))


def _windows(df: DataFrame, key: str, window: int) -> DataFrame:
    """(key, pos, hash, own) of every window of ``window`` template tokens; shorter texts have none.

    A window with a single word at the start of a sentence has a second hash with that word as it
    is (``own``), which copies in capitals or small letters share. A window's hash is put together from those
    of its halves, each a column that is computed once. The outer explode keeps Spark from deriving
    a filter that would compute the whole chain once more.
    """
    marked = df.select(F.col(key).alias("key"), marked_tokens(F.col("text")).alias("marked"))
    hashed = marked.select(
        "key", "marked", F.size("marked").alias("n"), F.transform("marked", template_hash).alias("open1")
    )
    # The hashes differ only at single words that start a sentence.
    start = lambda t: t.startswith("_s") & (F.locate("_", t, 3) == 0)
    own = F.zip_with("marked", "open1", lambda t, o: F.when(start(t), F.xxhash64(F.substr(t, F.lit(3)))).otherwise(o))
    rows = hashed.select("key", "n", "open1", own.alias("word1"))

    def follow(left: str, right: str, by: int) -> Column:
        """Hashes of the spans of ``left`` and the spans of ``right`` that come ``by`` tokens later."""
        return F.zip_with(left, F.slice(right, by + 1, F.greatest(F.col("n"), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    forms, size = ("open", "word"), 1
    while 2 * size <= window:
        rows = rows.select("*", *[follow(f"{f}{size}", f"{f}{size}", size).alias(f"{f}{2 * size}") for f in forms])
        size *= 2
    spans, covered = size, size
    while covered < window:
        size //= 2
        if covered + size <= window:
            rows = rows.select("*", *[follow(f"{f}{spans}", f"{f}{size}", covered).alias(f"{f}_{covered + size}") for f in forms])
            covered += size
            spans = f"_{covered}"
    last = F.col("n") - window
    whole = [F.when(last >= 0, F.slice(f"{f}{spans}", F.lit(1), F.greatest(last + 1, F.lit(1)))).alias(f) for f in forms]
    both = rows.select("key", "n", *whole)
    each = F.concat("open", F.zip_with("open", "word", lambda o, w: F.when(o != w, w)))
    opened = both.select("key", "n", each.alias("windows")).select("key", "n", F.posexplode_outer("windows").alias("at", "hash"))
    opened = opened.where("hash is not null")
    return opened.select("key", (F.col("at") % (last + 1)).alias("pos"), "hash", (F.col("at") > last).alias("own"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, width, item_pos, hash); an item of fewer than ``window`` tokens is one window of its own width.

    Such a window needs a word: placeholders alone would meet any value.
    """
    tokens = benchmark.where("item_id is not null").select("item_id", "text", marked_tokens(F.col("text")).alias("tokens"))
    word = F.exists("tokens", lambda t: ~t.startswith("_") & ~F.ascii(t).between(48, 57))
    sized = tokens.select("item_id", "text", F.least(F.size("tokens"), F.lit(window)).alias("width"), word.alias("word"))
    sized = materialize(sized.where("width > 0"), "item-texts")
    out = None
    for width in _widths(sized) or [window]:
        of_width = sized.where(F.col("width") == width)
        if width < window:
            worded = _windows(of_width.where("word"), "item_id", width)
            rows = worded.unionByName(_windows(of_width.where("not word"), "item_id", width).where("own"))
        else:
            rows = _windows(of_width, "item_id", width)
        rows = rows.select(F.col("key").alias("item_id"), F.lit(width).alias("width"), F.col("pos").alias("item_pos"), "hash")
        out = rows if out is None else out.unionByName(rows)
    return materialize(out, "items")


def _widths(items: DataFrame) -> list[int]:
    """Window widths in use: one, and as many more as there are lengths of shorter items."""
    return sorted(r.width for r in items.select("width").distinct().collect())


def _aligned(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Windows that documents and items share, as a row per document, item and alignment: (n, least, most)."""
    places = items.groupBy("hash").agg(F.collect_list(F.struct("item_id", "item_pos")).alias("places"))
    if items.count() <= ITEM_WINDOWS:
        places = F.broadcast(places)
    found = None
    for width in _widths(items):
        met = _windows(docs, "doc_id", width).join(places, "hash")
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = _windows(docs, "doc_id", window).join(places, "hash")
    # An array of places keeps the join at one row a window; it opens inside the aggregation's input.
    opened = found.select(F.col("key").alias("doc_id"), "pos", F.explode("places").alias("p"))
    return opened.groupBy(
        "doc_id", F.col("p.item_id").alias("item_id"), (F.col("pos") - F.col("p.item_pos")).alias("shift")
    ).agg(F.collect_set("p.item_pos").alias("item_places"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, consistent: float = CONSISTENT
) -> DataFrame:
    """One row per document and item it contains.

    doc_id, item_id, windows (of the item found), item_windows, slots (placeholders on found
    windows), agreeing (slots whose values map one to one), all of the fullest run that passes. A
    pair counts when a run of alignments (``_runs``) holds at least ``share`` of the item's windows
    and at least ``consistent`` of its slots agree (no slots agree trivially). Null doc_ids and
    item_ids are left out, null texts are empty, rows that repeat an id are taken as parts of one
    text each aligned on its own. An item of fewer than ``window`` tokens is found where all its
    tokens stand in a row; one of numbers, units and names alone, or without tokens, is never found.
    """
    own = docs.where("doc_id is not null").select("doc_id", "text")
    items = item_windows(benchmark, window)
    sizes = items.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows"), F.max("width").alias("width"))
    aligned = materialize(_aligned(own, items, window), "aligned")
    totals = aligned.groupBy(*PAIR).agg(_covered_windows().alias("windows"))
    enough = totals.join(sizes, "item_id").where(F.col("windows") >= share * F.col("item_windows"))
    candidates = materialize(aligned.join(enough.drop("windows"), PAIR), "candidates")
    runs = _runs(candidates)
    full = runs.groupBy(*RUN).agg(_covered_windows().alias("windows"), F.first("item_windows").alias("item_windows"))
    full = materialize(full.where(F.col("windows") >= share * F.col("item_windows")), "runs")
    slots = _slots(own, benchmark, candidates, runs.join(full.select(*RUN), RUN, "left_semi"))
    judged = full.join(slots, RUN, "left").fillna(0, ["slots", "agreeing"])
    passed = judged.where(F.col("agreeing") >= consistent * F.col("slots"))
    best = passed.groupBy(*PAIR).agg(F.max(F.struct("windows", "agreeing", "slots", "item_windows")).alias("b"))
    return best.select(*PAIR, "b.windows", "b.item_windows", "b.slots", "b.agreeing")


def _covered_windows() -> Column:
    return F.size(F.array_distinct(F.flatten(F.collect_list("item_places")))).cast("long")


def _runs(aligned: DataFrame) -> DataFrame:
    """Alignments by the runs they belong to: ``aligned`` with (kind, run), rows repeated per kind.

    A run is one alignment; or neighbouring alignments, no two neighbours half an item apart, as
    words put into a copy shift what follows; or all alignments of the pair, as a copy may be torn
    apart. Copies of one item in a document are so judged each on its own as well as together.
    """
    ordered = Window.partitionBy(*PAIR).orderBy("shift")
    apart = F.col("shift") - F.lag("shift").over(ordered) >= (F.col("item_windows") + F.col("width") - 1) / 2
    marked = aligned.withColumn("near", F.sum(F.when(apart, 1).otherwise(0)).over(ordered))
    kinds = [("alignment", "shift"), ("near", "near"), ("whole", None)]
    each = F.array(
        *[F.struct(F.lit(k).alias("kind"), (F.col(c) if c else F.lit(0)).cast("long").alias("run")) for k, c in kinds]
    )
    return marked.select(*aligned.columns, F.explode(each).alias("r")).select(*aligned.columns, "r.kind", "r.run")


def _slots(docs: DataFrame, benchmark: DataFrame, aligned: DataFrame, runs: DataFrame) -> DataFrame:
    """Slots on the aligned windows of each run, and how many agree: (doc_id, item_id, kind, run, slots, agreeing).

    Where alignments of a run overlap on the item, the one with most windows counts. For each value
    on one side the value it meets most often is its partner; a slot agrees if its two values are
    each other's partners.
    """

    def slot_values(df: DataFrame, key: str, place: str, value: str) -> DataFrame:
        tokens = df.select(key, F.posexplode_outer(marked_tokens(F.col("text"))).alias(place, value))
        return tokens.where(F.col(value).startswith("_") | F.ascii(value).between(48, 57)).distinct()

    covered = aligned.select(
        "doc_id",
        "item_id",
        "shift",
        F.explode(
            F.array_distinct(
                F.flatten(F.transform("item_places", lambda p: F.sequence(p, p + F.col("width") - 1)))
            )
        ).alias("item_pos"),
    )
    items = slot_values(benchmark.where("item_id is not null").select("item_id", "text"), "item_id", "item_pos", "theirs")
    asked = covered.join(F.broadcast(items), ["item_id", "item_pos"]) if _few(items) else covered.join(items, ["item_id", "item_pos"])
    asked = asked.withColumn("pos", F.col("item_pos") + F.col("shift"))
    hit = docs.join(aligned.select("doc_id").distinct(), "doc_id", "left_semi")
    met = asked.join(slot_values(hit, "doc_id", "pos", "ours"), ["doc_id", "pos"])
    members = runs.select(*RUN, "shift", F.struct(F.size("item_places"), -F.col("shift")).alias("weight"))
    shared = met.join(members, [*PAIR, "shift"])
    best = F.max("weight").over(Window.partitionBy(*RUN, "item_pos"))
    kept = shared.withColumn("best", best).where("weight = best")
    counts = materialize(kept.groupBy(*RUN, "theirs", "ours").agg(F.count("*").alias("n")), "slots")
    partner = lambda a, b: counts.groupBy(*RUN, a).agg(F.max_by(b, F.struct("n", b)).alias(f"of_{a}"))
    both = counts.join(partner("theirs", "ours"), [*RUN, "theirs"]).join(partner("ours", "theirs"), [*RUN, "ours"])
    agree = (F.col("of_theirs") == F.col("ours")) & (F.col("of_ours") == F.col("theirs"))
    return both.groupBy(*RUN).agg(F.sum("n").alias("slots"), F.sum(F.when(agree, F.col("n")).otherwise(0)).alias("agreeing"))


def _few(items: DataFrame) -> bool:
    return items.count() <= ITEM_WINDOWS


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id has no contaminated pair; null doc_ids stay."""
    bad = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
