import numpy as np
from test_language import DE, EN, RU, docs

import corpus_pipeline

FR = "les enfants mangent souvent une pomme rouge dans leur jardin avec des amis pour jouer ensemble"


def test_texts_of_several_languages_stay(spark):
    """Clean texts stay, however many languages they mix; texts in a script that nothing was learned of go."""
    rng = np.random.default_rng(0)
    spoken = [("en", EN.split()), ("de", DE.split()), ("ru", RU.split()), ("fr", FR.split())]
    rows = [(i, " ".join(rng.choice(spoken[i % 4][1], 30)), spoken[i % 4][0]) for i in range(400)]
    three, four = " ".join([EN, DE, RU]), " ".join([EN, DE, RU, FR])
    rows += [(1000, three, None), (1001, four, None), (1002, "漢字 " * 30, None), (1003, "漢字 " * 30 + "the", None), (1004, "12 -", None), (1005, None, None)]
    rows += [(1006, EN + " 漢字", None)]
    plain = docs(spark, rows).drop("id", "held_out", "spans")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, plain, "").collect()}
    assert kept & set(range(1000, 1007)) == {1000, 1001, 1006}
    assert kept >= set(range(400))
