"""Personal data, passages, decontamination and packing against plain definitions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from capframe.llm import decontaminate, packing, passages, pii

# Contract patterns, written as given.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(digits[::-1], 1)]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def slow_spans(text):
    found = [
        (m.start(), k, m.end(), kind)
        for k, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "")
        if passes(kind, m[0])
    ]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


HARD = [
    None, "", "a@b.c d@e", "a@b@c.d.e", "..@x.y-z.", "@a.b", "1.2.3.4.5.6.7.8", "1.2.3.999 1.2.3.4", "01.002.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "0" * 300, "1 2 3 4 5 6 7 8 9 0 1 2 3", "+1 (415) 555-2671",
    "+1+1 415 555 2671.", "+49 30 1234567890123", "é 😀 x@y.zz +44 20 7946 0958", "x" * 5000 + "@" + "y" * 5000 + ".com",
]


def test_base_spans_by_definition(spark, sf):
    given = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = HARD + given
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs.select("*", F.lit(1).alias("base"), F.lit(2).alias("spans"))).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        spans, row = slow_spans(text), found[i]
        kinds = Counter(s.split(":")[0] for s in spans)
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(kinds[k] for k in BASE)
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        left = Counter(spans) - Counter(row.spans.split(","))
        assert not left, (text, left)
    assert pii.find(docs.where("false")).count() == 0


def test_labelers_and_mask(spark):
    texts = [f"Contact Dr Anna Miller{i} please, phone (415) 555-01{i:02d} now" for i in range(30)]
    texts += [f"Total 123 456 7890 1234 {i} items. Nothing personal here at all." for i in range(30)]
    texts += [f"write to anna.m{i} [at] mail [dot] com or a{i}@b.org" for i in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, masked_text long")
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    out = {r.doc_id: r.text for r in masked.collect()}
    assert all("555" not in out[i] for i in range(30))
    # A tenth of these numbers pass the check digit and are cards.
    assert all(out[i] == texts[i] for i in range(30, 60) if not slow_spans(texts[i]))
    assert all("[at]" not in out[i] and "@" not in out[i] for i in range(60, 80))
    assert out[80] is None and out[81] == ""


def test_planted_spans_of_every_kind(spark):
    """Recall and precision per kind on varied sentences, with look-alikes that are not personal."""
    import random

    rng = random.Random(11)
    pick = lambda *some: rng.choice(some)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: pick("river", "garden", "paper", "market", "window", "yellow", "seven", "quiet", "forest", "table")
    area = lambda: pick(*sorted(pii.AREA_CODES))
    real = {
        "email": lambda: f"{pick('mail', 'contact', 'write to', 'ask')} {word()}.{word()}{pick(' [at] ', '(at)')}{word()}{pick(' [dot] ', '.')}{pick('com', 'org', 'de')}",
        "ip": lambda: f"{pick('host', 'address', 'from', 'server')} " + ":".join(code(4) for _ in range(8)),
        "phone": lambda: f"{pick('call', 'phone', 'tel', 'reach us under')} {pick(f'({area()}) ', f'{area()}-')}555-{digits(4)}",
        "name": lambda: f"{pick('Dr', 'by', 'Mrs', 'with')} {pick('Anna', 'Peter', 'Maria', 'John')} {word().title()}",
        "secret": lambda: f"{pick('token', 'key', 'password', 'uses')} {code(pick(32, 40, 64))}",
    }
    false = {
        "phone": lambda: f"{pick('order', 'part', 'total')} 000 {digits(3)} {digits(4)}",
        "secret": lambda: f"{pick('checksum', 'line')} {pick('0', 'a', 'f') * 32}",
        "email": lambda: f"{pick('sold', 'bought')} {digits(2)} (at) {digits(1)}.{digits(2)} each",
    }
    docs, wanted = [], Counter()
    for i in range(600):
        kind, planted = rng.choice([(k, f()) for k, f in real.items()] + [("none", f()) for f in false.values()])
        docs.append((i, f"The {word()} and the {word()} {planted} {word()} near the {word()}.", kind))
        wanted[kind] += 1
    table = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    right, found = Counter(), Counter()
    for r in pii.find(table).collect():
        kinds = {s.split(":")[0] for s in r.spans.split(",") if s}
        right[docs[r.doc_id][2]] += docs[r.doc_id][2] in kinds
        found.update(kinds)
    print(wanted, right, found)
    for kind in real:
        assert right[kind] >= 0.95 * wanted[kind] and right[kind] >= 0.9 * found[kind], kind


def test_reliabilities_follow_the_truth():
    soft = pii.reliabilities({"3++++2": 50.0, "3++002": 40.0, "3--0-2": 60.0, "30-0-2": 40.0})
    assert soft["3++++2"] > 0.9 > 0.1 > soft["3--0-2"]


def slow_passages(rows, least):
    seen = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        words = (text or "").split()
        for i in range(len(words) - least + 1):
            seen[tuple(words[i : i + least])].append((k, i))
    out = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                out[rows[k][0]].update(range(i, i + least))
    return {d: len(w) for d, w in out.items()}


def test_passages_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: r.dup_words for r in passages.repeated(docs).collect()}
    assert found == slow_passages(rows, 50)


def test_passages_small(spark):
    import random

    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(400)}"
    shared = [[word() for _ in range(n)] for n in (9, 10, 12, 25, 40)]
    texts = []
    for i in range(120):
        parts = [[word() for _ in range(rng.randrange(1, 15))], rng.choice(shared), [word() for _ in range(5)]]
        parts.append(rng.choice(shared)[rng.randrange(4) :])
        texts.append(" ".join(sum(parts, [])))
    texts += ["z " * 60, None, "", "one two", "q " * 200]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, start int")
    found = {r.doc_id: r.dup_words for r in passages.repeated(docs, least=10, seed=4).collect()}
    assert found == slow_passages(rows, 10)
    assert passages.repeated(docs.where("false")).count() == 0
    assert passages.repeated(docs.select(F.lit(None).cast("long").alias("doc_id"), "text")).count() == 0


ITEM = "Anna buys 12 apples and 7 pears for 30 euros while Peter sells 12 apples each morning before school starts"


def test_decontamination_finds_new_parameters(spark):
    filler = " and the river went slowly over stones until evening came over the quiet valley "
    texts = {
        1: filler + ITEM + filler,
        2: filler + ITEM.replace("12", "45").replace("7", "9").replace("30", "81") + filler,
        3: filler * 3,
        4: None,
        5: "",
        6: filler + "Anna buys 3 apples and 3 pears for 3 euros while Peter sells 9 apples each morning before school starts" + filler,
    }
    schema = "doc_id long, text string, hash string, item_id int"
    docs = spark.createDataFrame([(i, t, "h", 0) for i, t in texts.items()] + [(None, ITEM, "h", 0)], schema)
    bench = spark.createDataFrame([(9, ITEM), (10, None), (11, ""), (None, ITEM), (12, "too short")], "item_id long, text string")
    pairs = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(1, 9), (2, 9)} <= set(pairs) and not {3, 4, 5} & {d for d, _ in pairs}
    assert (6, 9) not in pairs  # one value stands for several: slots disagree
    # At the start of a text a capital marks no name, so the item's first window differs inside a document.
    assert pairs[1, 9].windows == pairs[1, 9].item_windows - 1
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 3, 4, 5, 6]
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


def test_decontamination_judges_each_copy(spark):
    """Copies with different parameters in one document are each enough; a copy cut by other words still is."""
    filler = " and the river went slowly over stones until evening came over the quiet valley "
    vary = lambda a, b, c: ITEM.replace("12", a).replace("7", b).replace("30", c)
    wrong = "Anna buys 3 apples and 3 pears for 3 euros while Peter sells 9 apples each morning before school starts"
    cut = lambda text: text.replace("while", "as the wind blew while")
    texts = {
        1: filler + ITEM + filler + vary("45", "9", "81") + filler,
        2: filler + vary("45", "9", "81") + filler + vary("9", "45", "7") + filler,
        3: vary("45", "9", "81") + " " + ITEM + " " + wrong,
        4: filler + cut(ITEM) + filler,
        5: filler + cut(vary("45", "9", "81")) + filler + cut(vary("9", "45", "7")) + filler,
        6: filler + wrong + filler + wrong,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    pairs = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()]
    assert sorted(pairs) == [(i, 9) for i in range(1, 6)]


def test_decontamination_finds_new_numbers_and_names(spark):
    filler = " and the river went slowly over stones until evening came over the quiet valley. "
    items = {
        1: "Mary Jones paid 950 euros for chairs. Then Peter Smith sold Mary Jones tables for 950 euros more today",
        2: "The farm sold 950 pears while 3 boys ate apples near the old barn this cold morning",
        3: "How long does it take? Anna walks home. Anna sleeps there until noon. Peter works. Peter reads there until late",
        4: "The Great Green River Flows Down Past Many Old Stone Houses Every Day",
    }
    swap = {"Mary Jones": "Eva Maria Berg", "Peter Smith": "Tom", "Anna": "Lee Ann", "Peter": "Kim", "950": "1,250", "3": "2.5"}

    def vary(text):
        return re.sub("|".join(swap), lambda m: swap[m[0]], text)

    rows = [(i, filler + t + filler) for i, t in items.items()] + [(10 + i, filler + vary(t) + filler) for i, t in items.items()]
    rows.append((20, filler + "A Small White House Stands Near Some Tall Trees Behind Another Long Wall" + filler))
    rows += [(23, filler + items[3].upper() + filler), (33, filler + items[3].lower() + filler)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    pairs = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert pairs == {(i, i) for i in items} | {(10 + i, i) for i in items} | {(23, 3), (33, 3)}


def test_decontamination_on_documents(spark, sf):
    """Every document that holds an item word for word is found."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in r.text}
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert exact and exact <= found


def test_decontamination_is_native(spark, sf):
    frame = decontaminate.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    plan = frame._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def plain_cost(c, overhead, attention):
    return overhead + c + c * c / attention


def slow_packing(sizes, capacities, overhead, attention, floor):
    """One packing by definition; without a floor each bin opens at the capacity of least expected cost per token."""
    bins = []
    for i, size in enumerate(sizes):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size]
        if fits:
            k = min(fits)[1]
        else:
            cost = {}
            for c in (c for c in capacities if c >= size):
                held = size
                for later in sizes[i + 1 :]:
                    held += later if held + later <= c else 0
                cost[c] = plain_cost(min(x for x in capacities if x >= held), overhead, attention) / held
            choice = min(cost, key=lambda c: (cost[c], c)) if floor is None else min(c for c in cost if c >= floor)
            k = len(bins)
            bins.append({"room": choice, "held": []})
        bins[k]["held"].append(size)
        bins[k]["room"] -= size
    return sorted((min(c for c in capacities if c >= sum(b["held"])), sorted(b["held"])) for b in bins)


def test_best_fit_by_definition():
    import random

    rng = random.Random(4)
    for trial in range(80):
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 60))), reverse=True)
        overhead, attention = rng.choice([(4, 64), (0, 16), (30, 10_000)])
        placed, ends = packing.best_fit(sizes, (8, 16, 64), overhead, attention)
        held = [[] for _ in ends]
        for size, (k, at) in zip(sizes, placed):
            assert at == sum(held[k])
            held[k].append(size)
        ways = [slow_packing(sizes, (8, 16, 64), overhead, attention, f) for f in (None, 8, 16, 64)]
        total = lambda way: sum(plain_cost(c, overhead, attention) for c, _ in way)
        assert sorted((c, sorted(h)) for c, h in zip(ends, held)) == min(ways, key=total)


def test_sizes_are_chosen_jointly():
    """On varied lengths several sizes open, and the cost is below every single opening size."""
    import random

    rng = random.Random(7)
    sizes = sorted((min(4096, max(1, int(rng.lognormvariate(5.5, 1.1)))) for _ in range(5_000)), reverse=True)
    total = lambda ends: sum(map(packing.sequence_cost, ends))
    _, ends = packing.best_fit(sizes)
    single = {
        c: total(packing.fill_bins(sizes, packing.CAPACITIES, lambda i, c=c: packing.smallest(max(sizes[i], c), packing.CAPACITIES))[1])
        for c in packing.CAPACITIES
    }
    assert len(set(ends)) >= 3
    assert total(ends) <= min(single.values()) and total(ends) < 0.95 * single[4096]


def test_repeated_and_missing_ids_spread(spark):
    """Rows without an id, and rows that repeat one, are dealt over all shards, copies by partition; ids stay exact."""
    rows = [(None, f"word {i} " * (i % 40)) for i in range(1_500)]
    rows += [(2**60 + 1, f"other {i} " * (1 + i % 9)) for i in range(1_500)] + [(9, "same text here")] * 600
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    packed = packing.pack(docs, shard_tokens=5_000).collect()
    shards = lambda rows: {r.bin_id.split("-")[0] for r in rows if r.bin_id}
    every = shards(packed)
    assert len(every) > 8 and len(packed) == len(rows)
    assert shards(r for r in packed if r.doc_id is None) == every
    assert shards(r for r in packed if r.doc_id == 2**60 + 1) == every
    assert len(shards(r for r in packed if r.doc_id == 9)) > 1


def test_packing_places_every_token_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("shard"), F.lit(2).alias("n"))
    extra = spark.createDataFrame([(None, "a b", 1, 2), (-5, None, 1, 2), (-6, " ", 1, 2), (-7, "w " * 10_000, 1, 2), (-7, "x", 1, 2)], docs.schema)
    docs = docs.unionByName(extra)
    rows = packing.pack(docs, shard_tokens=20_000).collect()
    want, got = Counter(), Counter()
    for r in docs.collect():
        want[r.doc_id] += len((r.text or "").split())
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.n_tokens
        assert (r.bin_id is None) == (r.n_tokens == 0)
        if r.bin_id is not None:
            bins[r.bin_id, r.bin_capacity, r.bin_tokens].append((r.bin_offset, r.n_tokens))
    assert got == want and set(got) == set(want)
    assert len({b for b, _, _ in bins}) == len(bins)
    for (_, capacity, tokens), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at == tokens <= capacity == min(c for c in packing.CAPACITIES if c >= tokens)
    assert packing.pack(docs.where("false")).count() == 0


def test_items_shorter_than_a_window(spark):
    """Items of one to four template tokens are found word for word and with other values, and only whole."""
    items = [(1, "What is 2 + 2?"), (2, "Nevertheless"), (3, "one two three four"), (4, "..."), (5, None), (6, "a five token item here")]
    docs = [
        (10, "They ask: what is 2 + 2? Nobody knows."), (11, "They ask: what is 7 + 7? Nobody knows."),
        (12, "They ask: what is 7 + 9? Nobody knows."), (13, "one two three, and four"), (14, "so one two three four"),
        (15, "nevertheless it goes on"), (16, "2 + 2"), (17, "here is a five token item here again"), (18, "a five token item"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.windows, r.item_windows) for r in decontaminate.contaminated(table, asked).collect()}
    assert found == {(10, 1): (1, 1), (11, 1): (1, 1), (14, 3): (1, 1), (15, 2): (1, 1), (17, 6): (1, 1)}
