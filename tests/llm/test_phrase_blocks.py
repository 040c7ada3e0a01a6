"""A test set over the bound is searched in blocks, with the rows of one search."""

import random

from proofmill.llm import phrase_index


def test_blocks_give_the_rows_of_one_search(spark, monkeypatch):
    rnd = random.Random(7)
    pool = [f"w{i}" for i in range(40)]
    items = [(i if i % 9 else None, " ".join(rnd.choices(pool, k=rnd.choice([3, 10, 14])))) for i in range(30)] + [(50, None), (51, "..."), (4, "w1 w2 w3")]
    docs = [(rnd.choice([None, 1, 2, 3]), " ".join(" ".join(rnd.choice([items[rnd.randrange(30)][1], *rnd.choices(pool, k=2)]).split()) for _ in range(12))) for _ in range(25)] + [(9, None), (9, "")]
    # two items that follow each other in a text make one span
    docs.append((10, items[0][1] + " " + items[29][1]))
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string").coalesce(1)

    def rows():
        return sorted(map(repr, phrase_index.decontaminate(d, b).collect()))

    one = rows()
    monkeypatch.setattr(phrase_index, "MAX_TEST_WORDS", 20)
    assert len(list(phrase_index.blocks(b))) > 3
    assert rows() == one and any("Row(first" in r for r in one)


def test_op9_stores_all_postings(spark, monkeypatch):
    built, build = [], phrase_index.build_index
    monkeypatch.setattr(phrase_index, "build_index", lambda *a, **k: built.append(build(*a, **k)) or built[-1])
    phrase_index.op9_phrase_index(spark, "/root/testdata/sf0.001")
    rows = [r for index in built for r in index.collect()]
    assert sum(sum(r.counts) for r in rows) == sum(sum(r.n_words) for r in rows) > 0
