"""Decontamination of documents with several occurrences, and of items of few words."""

from corpuskiln.llm.decontaminate import contamination

QUESTION = "A train leaves the old station with 40 people and then 12 km later picks up another 7 people near the river bend today"
NUMBERS = "3 17 29 41 58 66 73 88 92 105 117 126"
NAMES = "Call Alice Bob Carol Dave Erin Frank Grace Heidi"


def test_each_occurrence_is_checked(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, NUMBERS), (3, NAMES)], "item_id long, text string")
    one, two = QUESTION.replace("40", "55").replace("12", "13"), QUESTION.replace("40", "61").replace("7 people", "9 people")
    torn = lambda q: q.replace("and then", "and only then")
    crossed = "a train leaves the old station with 41 people . a train leaves the old station with 42 people"
    rows = [
        (20, f"{one}. {QUESTION}"), (21, f"{one}. {two}"), (22, f"{torn(one)} . {torn(two)}"), (23, f"so {NUMBERS} it is"), (24, f"so {NUMBERS.replace('29', '30').replace('73', '74').replace('105', '1')} it is"),
        (25, f"We {NAMES.upper()} now"), (26, crossed),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (4_000_000, 0):
        got = {(r.doc_id, r.item_id): r.kind for r in contamination(docs, items, most_broadcast=most).collect()}
        assert got == {(20, 1): "exact", (21, 1): "reparameterised", (22, 1): "reparameterised", (23, 2): "exact", (25, 3): "exact"}
