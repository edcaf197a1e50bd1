"""What the toxicity model says where nothing parts the texts."""

import random

from kgspark.llm import toxicity


def shuffled(spark, share, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "of", "the"]
    rows = []
    for i in range(400):
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(rng.random() < share)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_without_an_informative_word_severity_is_the_share_of_grades(spark):
    d = shuffled(spark, 0.1)
    share = d.where("toxic = 1").count() / d.count()
    model = toxicity.fit(d, d)
    assert len(model.weights[0]) == 0
    got = toxicity.score(d, model).collect()
    assert len(got) == 400 and not any(r.toxic or r.grade for r in got)
    assert all(abs(r.severity - share) < 0.01 for r in got)


def test_random_labels_flag_none(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))), int(rng.random() < 0.2)) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d, d.where("doc_id % 4 <> 0"))
    assert sum(r.toxic for r in toxicity.score(d, model).collect()) <= 6


def test_a_probability_at_the_cut_is_not_over_it(spark):
    d = shuffled(spark, 0.5)
    model = toxicity.OrdinalModel(toxicity.fit(d, d).weights, [6.6e-11])
    assert not any(r.toxic for r in toxicity.score(d, model).collect())
    model.thresholds[0] = -6.6e-11
    assert not any(r.toxic for r in toxicity.score(d, model).collect())
