import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilwork.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_model_orders_grades():
    rng = np.random.default_rng(4)
    rows, grades = [], []
    for _ in range(300):
        g = int(rng.integers(0, 3))
        own = np.array([1, 2 + g], np.int32)
        rows.append((own, np.ones(2, np.float32)))
        grades.append(g)
    model = q.fit_ordinal(rows, np.array(grades), 3)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.array([float(model.weights[[1, 2 + g]].sum()) for g in range(3)])
    tails = model.tails(score)
    assert (np.diff(score) > 0).all()
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.rint(tails.sum(1)).astype(int).tolist() == [0, 1, 2]


def likelihood(rows, grades, x, cuts):
    """The logarithm of the ratings' probability, by plain sums."""
    total = 0.0
    for (at, value), g in zip(rows, grades, strict=True):
        score = sum(x[a] * float(v) for a, v in zip(at, value, strict=True))
        tails = [1.0, *(1 / (1 + math.exp(c - score)) for c in cuts), 0.0]
        total += math.log(tails[g] - tails[g + 1])
    return total


def made_rows(n, n_grades, seed):
    rng = np.random.default_rng(seed)
    grades = rng.integers(0, n_grades, n)
    rows = []
    for g in grades:
        at = np.sort(rng.choice(9, int(rng.integers(1, 6)), replace=False)).astype(np.int32)
        rows.append((at, (rng.random(len(at)) + 0.2 * g).astype(np.float32)))
    return rows, grades


def block_of(rows, grades, used):
    block = q._Block(grades, np.array([len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
    block.narrow(np.array(used))
    return block


@pytest.mark.parametrize("n_grades", [2, 3, 5])
def test_gradient_against_differences_of_a_plain_likelihood(n_grades):
    rows, grades = made_rows(40, n_grades, n_grades)
    x, cuts = np.random.default_rng(1).normal(size=9), np.linspace(-1, 1.5, n_grades - 1)
    by_weight, by_cut = block_of(rows, grades, range(9)).gradient(x, cuts)
    for v, found in ((x, by_weight), (cuts, by_cut)):
        for i, g in enumerate(found):
            at, sides = v[i], []
            for d in (1e-5, -1e-5):
                v[i] = at + d
                sides.append(likelihood(rows, grades, x, cuts))
            v[i] = at
            assert g == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-4)
    used, alone = [1, 4, 7], np.zeros(9)
    alone[used] = x[used]
    assert block_of(rows, grades, used).gradient(x[used], cuts)[0] == pytest.approx(block_of(rows, grades, range(9)).gradient(alone, cuts)[0][used])
    assert not block_of(rows, grades, [100]).gradient(np.ones(1), cuts)[0].any()


def test_fit_is_a_maximum_of_the_plain_likelihood():
    rows, grades = made_rows(200, 3, 7)
    model = q.fit_ordinal(rows, grades, 3, steps=3000, rate=0.02, sparse=0.0)
    x, cuts = model.weights.astype(float), model.thresholds.copy()
    best = likelihood(rows, grades, x, cuts)
    for v, n in ((x, 9), (cuts, 2)):
        for i in range(n):
            for d in (0.05, -0.05):
                v[i] += d
                assert likelihood(rows, grades, x, cuts) < best
                v[i] -= d


def test_query_against_plain_sums(spark):
    """Each document's row of the registered query, from its tokens and the fitted weights."""
    from veilwork.llm.queries import op6_quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = q.fit(docs, q.grades_of(spark.read.parquet(f"{sf}/labels.parquet")), n_grades=3)
    rows = {r.doc_id: r for r in op6_quality(spark, sf).collect()}
    assert len(rows) == docs.count()
    bucket = lambda t: 1 + xxhash.xxh32_intdigest(t.encode()) % (q.BUCKETS - 1)
    for d in docs.collect():
        counts, tokens = {}, q.TOKENS.findall(d.text or "")
        for t in tokens:
            low = t.lower()
            own = [low] + [low[:n] + "-" for n in (4, 5, 6, 7) if t[0].isalpha() and n < len(t)] + ["^"] * (t[0].isalpha() and len(t) > 1 and t.isupper())
            for x in own:
                counts[bucket(x)] = counts.get(bucket(x), 0) + 1
        score = sum(math.log(1 + n) * float(model.weights[b]) for b, n in counts.items())
        score += math.log(len(tokens) / len(set(tokens))) * float(model.weights[0]) if tokens else 0
        tails = [1 / (1 + math.exp(c - score)) for c in model.thresholds]
        r = rows[d.doc_id]
        assert (r.expected_grade, r.tail_probability) == pytest.approx((sum(tails), tails[1]), abs=1e-3)
        assert r.kept == (r.tail_probability >= 0.5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    grades = q.grades_of(spark.read.parquet(f"{SF}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = q.fit(docs, grades.where(~held), n_grades=3)
    rows = q.score(docs.join(grades.where(held), "doc_id"), model, wanted=2).collect()
    right = np.mean([(r.tail_probability >= 0.5) == (r.grade == 2) for r in rows])
    plain = max(np.mean([r.grade == 2 for r in rows]), np.mean([r.grade != 2 for r in rows]))
    assert len(rows) > 50 and right > plain and right >= 0.85


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "good fine text", 9), (2, None, 9), (None, "", 9), (1, "good fine text", 9)], "doc_id long, text string, tail_probability int")
    ratings = spark.createDataFrame([(1, 2), (1, 1), (None, 0), (2, None), (3, 7)], "doc_id long, grade int")
    model = q.fit(docs, ratings, n_grades=3)
    out = q.score(docs, model, wanted=2)
    rows = out.collect()
    assert sorted(out.columns) == ["doc_id", "expected_grade", "tail_probability", "text"]
    assert len(rows) == 4 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    kept = q.select(docs, model, wanted=1, least=0.0)
    assert kept.columns == docs.columns and kept.count() == 4
    assert q.score(docs.limit(0), model, wanted=1).count() == 0


def test_without_ratings_each_tail_is_as_likely_as_not(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = q.fit(docs, spark.createDataFrame([], "doc_id long, grade int"), n_grades=3)
    assert q.score(docs, model, wanted=2).first()["tail_probability"] == pytest.approx(0.5)


def test_whole_text_counts():
    memory = q._Hash()
    short, long = q.features("word " * 10, memory), q.features("word " * 10 + "x " * 50_000 + "rare", memory)
    assert set(short[0]) < set(long[0])
    assert len(q.features(None, memory)[0]) == 0


def test_bound_and_fit_on_an_executor(spark):
    """The fit on an executor gives the model of a fit here; the bound is the documented one."""
    assert q.FIT_ROWS == 12_000
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} plain " * (1 + i % 4)) for i in range(60)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int")
    model = q.fit(docs, ratings, n_grades=3, steps=12)
    rows = [q.features(r.text, q._Hash()) for r in docs.orderBy("doc_id").collect()]
    want = q.fit_ordinal(rows, np.array([i % 3 for i in range(60)]), 3, steps=12)
    assert np.allclose(model.weights, want.weights, atol=1e-4) and np.allclose(model.thresholds, want.thresholds, atol=1e-4)
    assert np.abs(model.weights).max() > 0.01


def test_the_driver_gets_weights_only(spark, monkeypatch):
    """What comes to the driver does not grow with the labelled rows."""
    from pyspark.sql.classic.dataframe import DataFrame

    got = []
    monkeypatch.setattr(DataFrame, "collect", lambda self, f=DataFrame.collect: got.append(f(self)) or got[-1])
    monkeypatch.setattr(DataFrame, "toArrow", None)
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(40)], "doc_id long, text string")
    q.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 as int) AS grade"), n_grades=3, steps=2)
    assert len(got) == 1 and [[len(x) for x in r] for r in got[0]] == [[4 * q.BUCKETS, 16]]


def test_an_id_of_very_many_rows_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"word{i % 5} same") for i in range(3000)] + [(2, "other text")], "doc_id long, text string")
    ratings = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int")
    many = q.fit(docs, ratings, n_grades=2, steps=5)
    kept = {r.text for r in docs.where("doc_id = 1").distinct().collect()}
    fits = [q.fit(spark.createDataFrame([(1, t), (2, "other text")], "doc_id long, text string"), ratings, n_grades=2, steps=5) for t in sorted(kept)[:5]]
    assert any(np.array_equal(many.weights, one.weights) and np.array_equal(many.thresholds, one.thresholds) for one in fits)
