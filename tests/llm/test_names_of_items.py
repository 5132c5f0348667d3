"""Re-parameterised items whose names open sentences or have several words."""

from fixtures import edge_docs

from clauselake.llm import decontaminate

APPLES = "Tom has 5 red apples. Anna gives him 3 more. Tom eats 2 of them. How many apples does Tom have left?"
BUYS = "If Tom Miller buys 12 apples and Anna Jones buys 7 apples, how many apples do Tom Miller and Anna Jones have?"
PENS = "Ben sells 9 pens to Mary. Then Ben counts 4 pens in the box."
ITEMS = [(1, APPLES), (2, BUYS), (3, PENS), (4, "Rome."), (5, "Paris is big.")]
DOCS = [
    (1, "Some text here. " + APPLES.replace("Tom", "Peter").replace("Anna", "Zoe").replace("5", "8").replace("3", "11") + " And more."),
    (2, "So: " + BUYS.replace("Tom Miller", "Ben").replace("Anna Jones", "Mary").replace("12", "30")),
    (3, PENS.replace("Ben", "Mr. Lee").replace("Mary", "Eva Maria Stone").replace("9", "6")),
    (4, APPLES.replace("Tom has", "Peter has").replace("Anna", "Zoe").replace("Tom eats", "Olga eats").replace("does Tom", "does Ivan")),  # one name, three values
    (5, "London."), (6, "London is big."), (7, "Vienna"),
    (8, "If Anna has pens. How many of them are there in all the other boxes?"),
    (9, APPLES),
]


def test_names_that_open_sentences_and_names_of_several_words(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.find(edge_docs(spark, DOCS), items).collect()}
    assert set(rows) == {(1, 1), (2, 2), (3, 3), (9, 1)}
    assert rows[1, 1].reparameterised and rows[2, 2].reparameterised and rows[3, 3].reparameterised and not rows[9, 1].reparameterised
    assert (rows[1, 1].first_token, rows[1, 1].last_token) == (3, 24) and (rows[9, 1].first_token, rows[9, 1].last_token) == (0, 21)
    kept = {r.doc_id for r in decontaminate.clean(edge_docs(spark, DOCS), items).collect()}
    assert kept == {4, 5, 6, 7, 8}
