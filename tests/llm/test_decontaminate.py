import pytest

from conftest import ODD, words
from daycast.llm import decontaminate, queries
from daycast.llm.common import table

SMALL = "/root/testdata/sf0.001"
QUESTION = ("A farmer named Tom sells 12 baskets of fruit at the market for 30 dollars each day. "
            "If Tom sells 12 baskets every day, how many dollars does he earn in 5 days?")
OTHER = ("A farmer named Ann sells 70 baskets of fruit at the market for 95 dollars each day. "
         "If Ann sells 70 baskets every day, how many dollars does he earn in 8 days?")
MIXED = ("A farmer named Ann sells 70 baskets of fruit at the market for 95 dollars each day. "
         "If Bob sells 31 baskets every day, how many dollars does he earn in 8 days?")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, QUESTION), (2, words(*range(40), stem="item")), (3, None), (4, ""), (5, "short one here"),
         (6, words(*range(100, 118), stem="item"))], "item_id long, text string")


def found(df, items):
    return {r.doc_id: r.item_ids for r in decontaminate.report(df, items).collect() if r.contaminated}


def test_planted_and_clean(docs, items):
    filler = words(*range(60), stem="fill")
    rows = [(1, f"{filler} {QUESTION} {filler}"), (2, f"{filler}.\n{OTHER}"), (3, filler),
            (4, filler + " " + words(*range(10, 33), stem="item") + " " + filler),    # most of an item
            (5, filler + " " + words(*range(5), stem="item") + " " + filler),         # a few of its words
            (6, words(*range(100, 118), stem="item")),
            (7, "a market for fruit where a farmer sells baskets every day for dollars"),
            (8, filler + " " + words(*range(40), stem="item").upper())]
    got = found(docs(rows), items)
    assert got == {1: [1], 2: [1], 4: [2], 6: [6], 8: [2]}


def test_slots_must_be_consistent():
    def best(text):
        item = QUESTION.encode().split()
        t, k, v = decontaminate.template(item)
        h, ok = decontaminate.windows(t, k)
        place = {int(x): i for i, x in enumerate(h) if ok[i]}
        t2, k2, v2 = decontaminate.template(text.encode().split())
        h2, _ = decontaminate.windows(t2, k2)
        hits = [(i, place[int(x)], decontaminate._slots(k2, v2, i), decontaminate._slots(k, v, place[int(x)]))
                for i, x in enumerate(h2) if int(x) in place]
        return decontaminate.passages(hits, len(item))
    assert best(QUESTION) == best(OTHER) == len(QUESTION.split())
    assert best(MIXED) < best(OTHER)


def test_odd_rows(docs, items):
    out = decontaminate.report(docs(ODD), items)
    assert out.count() == len(ODD) and not found(docs(ODD), items)
    assert decontaminate.report(docs([]), items).count() == 0
    assert not found(docs([(1, QUESTION)]), items.limit(0))


def test_short_item_is_found_whole(docs, items):
    assert found(docs([(1, "short one here")]), items) == {1: [5]}


def test_short_item_inside_a_longer_document(docs, items, spark):
    filler = words(*range(30), stem="fill")
    rows = [(1, f"{filler} short one here {filler}"), (2, f"{filler} Short one, here."), (3, "the short one here now"),
            (4, f"{filler} short one {filler}"), (5, f"{filler} The 12 Bells rang")]
    assert found(docs(rows), items) == {1: [5], 2: [5], 3: [5]}
    few = spark.createDataFrame([(7, "The 12 Bells"), (8, "fill7")], items.schema)
    assert found(docs(rows[3:]), few) == {4: [8], 5: [7, 8]}


def test_items_of_numbers_and_names(docs, spark):
    numbers = " ".join(str(n * n + 7) for n in range(14))
    title = "Pride And Prejudice By Jane Austen Published In London By Thomas Egerton"
    own = spark.createDataFrame([(1, numbers), (2, title)], "item_id long, text string")
    filler = words(*range(30), stem="fill")
    rows = [(1, f"{filler} {numbers} {filler}"), (2, f"{filler} {title} {filler}"), (3, title.lower()),
            (4, f"{filler} {' '.join(str(n * n + 8) for n in range(14))}"),
            (5, f"{filler} War And Peace By Leo Tolstoy Published In Moscow By The Russian Messenger")]
    assert found(docs(rows), own) == {1: [1], 2: [2], 3: [2]}


def test_copy_after_other_values(docs, items):
    """A truncated variant, or a chance window, just before a copy does not hide it."""
    cut, chance = " ".join(OTHER.split()[:9]), "If Bob sells 31 baskets every day, how"
    rows = [(1, f"{cut} {QUESTION}"), (2, f"{chance} {QUESTION}"), (3, f"{chance} {cut}. {OTHER}"),
            (4, f"{cut} {chance}")]
    out = {r.doc_id: r.words for r in decontaminate.report(docs(rows), items).collect()}
    assert out == {1: len(QUESTION.split()), 2: len(QUESTION.split()), 3: len(QUESTION.split()), 4: 0}


def test_many_variants_in_a_row():
    """Work grows with the hits, not with their square."""
    hits = [(20 * v + k, k, [v * 4 + 4, 0, v * 4 + 8], [1, 0, 2]) for v in range(4000) for k in range(10)]
    assert decontaminate.passages(hits, 40) == 15


def test_clean_keeps_columns_and_rows(docs, items):
    d = docs(ODD + [(90, QUESTION), (None, OTHER), (91, "fine")])
    out = decontaminate.clean(d, items)
    assert out.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == \
        sorted((i or 0, t or "") for i, t in ODD + [(91, "fine")])


def test_whole_items_of_the_small_table_are_caught(spark):
    """Documents holding all words of an item in a row, and only such with many of its words."""
    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    items = [r.text.lower().split() for r in table(spark, SMALL, "benchmark").collect()]
    grams = [{tuple(w[k:k + 6]) for k in range(len(w) - 5)} for w in items]
    whole, some = set(), set()
    for r in rows:
        w = r.text.lower().split()
        own = {tuple(w[k:k + 6]) for k in range(len(w) - 5)}
        share = max(len(g & own) / len(g) for g in grams)
        whole |= {r.doc_id} if share == 1 else set()
        some |= {r.doc_id} if share > 0 else set()
    got = {r.doc_id for r in queries.QUERIES["op6_templates"](spark, SMALL).collect() if r.contaminated}
    assert whole and whole <= got <= some


def test_clashing_columns_of_the_benchmark(spark, docs, items):
    from pyspark.sql import functions as F
    wide = items.withColumns({c: F.lit("x") for c in ("doc_id", "row", "h", "at", "slots", "length", "__row", "words")})
    rows = [(1, QUESTION), (2, words(*range(60), stem="fill"))]
    assert found(docs(rows), wide) == found(docs(rows), items) == {1: [1]}
