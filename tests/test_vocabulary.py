"""Chi-square selection of terms, vocabularies that are saved and read again."""

import random

import pytest

from deskpass.operators import ml as ML
from deskpass.operators import vocabulary as VO
from deskpass.session import scratch_path
from deskpass.sources import files


def rows():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    return [(k, " ".join(rng.choices(words, k=rng.randint(0, 12)) + ["every"] + (["good"] if k % 3 == 0 else ["bad"] if k % 3 == 1 else [])), float(k % 3)) for k in range(200)] + [
        (900, None, 1.0), (901, "unlabelled words", None), (902, "", 0.0)]


def brute(data):
    own = [(set((t or "").split()), y) for _, t, y in data if y is not None]
    n, out = len(own), {}
    for term in set().union(*(t for t, _ in own)):
        df, chi = sum(term in t for t, _ in own), 0.0
        for y in {y for _, y in own}:
            size = sum(z == y for _, z in own)
            seen = sum(term in t for t, z in own if z == y)
            for o, e in ((seen, size * df / n), (size - seen, size * (n - df) / n)):
                chi += (o - e) ** 2 / e if e else 0.0
        out[term] = (df, round(chi, 6))
    return out


def test_chi_square_equals_brute_force(spark):
    d = spark.createDataFrame(rows(), "id long, text string, label double")
    got = {r.term: (r.df, round(r.chi2, 6)) for r in VO.chi_square(d).collect()}
    assert got == brute(rows())
    assert VO.chi_square(d.limit(0)).count() == 0


def test_best_terms_have_places_of_their_own(spark):
    d = spark.createDataFrame(rows(), "id long, text string, label double")
    v = VO.choose(VO.chi_square(d), 5)
    path = scratch_path(spark, "vocab")
    VO.save_vocabulary(v, path)
    back = VO.load_vocabulary(spark, path).orderBy("place").collect()
    assert [r.place for r in back] == list(range(5)) and {back[0].term, back[1].term} == {"good", "bad"}
    with pytest.raises(FileNotFoundError):
        VO.load_vocabulary(spark, path + "-none")


def test_text_features_use_the_chosen_terms_after_save_and_load(spark):
    from pyspark.ml import Pipeline
    d = spark.createDataFrame(rows(), "id long, text string, label double").where("label is not null and text is not null")
    model = Pipeline(stages=ML.text_features("text", "label", 2)).fit(d)
    path = scratch_path(spark, "features")
    files.save_model(model, path)
    again = files.load_model(path)
    vec = lambda m: {r.id: r.features for r in m.transform(d).collect()}
    assert vec(again) == vec(model)
    vocabulary = again.stages[1].stages[0].vocabulary
    assert set(vocabulary) == {"good", "bad"}
    assert vec(again)[0][vocabulary.index("good")] == 1.0 and vec(again)[2].numNonzeros() == 0
    with pytest.raises(ValueError):
        Pipeline(stages=ML.text_features("text", "label", 2)).fit(d.limit(0))
