from lexiloom.plans.derived import counted_words


def test_words_are_counted_without_sorting_all_of_them(spark):
    texts = spark.createDataFrame([("en", "The cat, the dog"), ("de", "the Hund"), ("en", "x1y"), (None, "cat")], "lang string, text string")
    words = counted_words(texts)
    assert {tuple(r) for r in words.collect()} == {("the", "de", 3), ("cat", "en", 2), ("dog", "en", 1), ("hund", "de", 1), ("x", "en", 1), ("y", "en", 1)}
    plan = [line.strip(" +-:*()0123456789") for line in words._jdf.queryExecution().sparkPlan().toString().splitlines()]
    # the aggregates from the words on: by hash first; it was a sort of every word of every text
    assert [line.split("(")[0] for line in plan if "Aggregate" in line][-1] == "HashAggregate"
