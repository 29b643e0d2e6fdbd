"""Short benchmark items with other numbers and names are found, and sentences that only look alike are not."""

from lodegrain.llm import decontam

PAIRS = [
    ("What is 12 times 45?", "What is 13 times 46?"),
    ("A car drives 60 km in 2 hours", "A car drives 90 km in 3 hours"),
    ("Solve 3 x plus 7 equals 22 for x", "Solve 4 x plus 9 equals 33 for x"),
    ("Compute 15 percent of 80", "Compute 25 percent of 60"),
    ("Anna has 3 apples and eats 1", "Bert has 5 apples and eats 2"),
    ("How many legs have 7 dogs?", "How many legs have 9 dogs?"),
    ("Add 4 to 4 twice", "Add 6 to 6 twice"),
    ("Round 3.14 to one digit", "Round 2.71 to two digit"),
]
OTHERS = [
    "This is 12 times 45.", "Where is 13 times 46?", "We ask what is 13 times 46?", "What is 13 times 46 more?", "A cat drives 60 km in 2 hours", "Compute 15 of 80 percent", "Anna has apples and eats 1", "How many legs have dogs?",
    "Add 4 to 5 twice", "add to four", "12 45", "", None,
]


def leaked(spark, docs, items):
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.n_changed) for r in decontam.leaks(d, b).collect())


def test_short_items_with_new_parameters(spark):
    items, docs = [a for a, _ in PAIRS], [f"Some words stand before. {b}\nAnd others after that." for _, b in PAIRS]
    got = leaked(spark, docs, items)
    assert [(d, i) for d, i, _ in got] == [(i, i) for i in range(len(PAIRS))] and all(n > 0 for _, _, n in got)


def test_sentences_that_look_alike_are_no_leaks(spark):
    assert leaked(spark, OTHERS, [a for a, _ in PAIRS]) == []


def test_ties_and_repeats(spark):
    """Items of one template are each reported, a sentence twice in a text once, repeated documents once a row, items of two words never."""
    items = ["What is 1 plus 2?", "What is 8 plus 9", "plus 2", None, ""]
    docs = ["What is 3 plus 4? What is 3 plus 4?", "What is 1 plus 2", "plus 2", None]
    assert leaked(spark, docs, items) == [(0, 0, 2), (0, 1, 2), (1, 0, 0), (1, 1, 2)]
