"""Plan features and pronouns hold to ASCII words' borders, as the SQL does."""

from pyspark.sql import functions as F

from corpusmill.operators import benchmarks as bm


def test_plan_features_on_odd_texts(spark):
    texts = ["ra.\nNoñasci", "nó noé", "NOT never", "5 \u212ag and 3 year\u017f", "a and b ñandñ ; \u00a0 ?", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, query string")
    got = bm.plan_features(rows).orderBy("id").select(*[F.array_size(c).alias(c) for c in ("numbers", "negations", "sub_questions")]).collect()
    # by hand, and as DuckDB says
    assert [tuple(x) for x in got] == [(0, 1, 1), (0, 1, 1), (0, 2, 1), (2, 0, 2), (0, 0, 3), (0, 0, 0), (None, None, None)]


def test_pronouns(spark):
    rows = spark.createDataFrame([(1, "Ité and it"), (2, "\u0130t THIS")], "session_id int, query string")
    s = spark.createDataFrame([(1, [], "X"), (2, [], "X")], "session_id int, entities array<string>, topic string")
    assert [x.resolved for x in bm.resolve_pronouns(rows, s).orderBy("session_id").collect()] == ["Xé and X", "\u0130t X"]
