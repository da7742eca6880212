import numpy as np
import pytest
from pyspark.sql import functions as F

from redloom.llm import reading as R
from redloom.session import table


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "reading_labels")
    graded = labels.where("grade is not null").groupBy("doc_id").agg(F.avg("grade").alias("g")).toPandas()
    model = R.train(docs, labels.where("doc_id % 4 <> 0"))
    test = graded[graded.doc_id % 4 == 0]
    level = R.reading_levels(docs, model).toPandas().set_index("key").reading_level.loc[test.doc_id].to_numpy()
    assert len(test) > 30 and np.abs(level - test.g).mean() < 1.6 and np.corrcoef(level, test.g)[0, 1] > 0.8


def test_easy_and_hard_and_edges(spark):
    easy, hard = "The cat sat. It was warm. We ran home.", "Notwithstanding extraterritorial jurisdiction, the unenforceable collateralisation presupposes organisational verification."
    model = R.fit([easy] * 20 + [hard] * 20, [2] * 20 + [13] * 20)
    df = spark.createDataFrame([(1, easy), (2, hard), (3, None), (4, ""), (5, "?! 。 ..."), (6, "one " * 50_000), (1, easy)], "doc_id long, text string")
    got = {r.key: r for r in R.reading_levels(df, model).collect()}
    assert got[1].reading_level < 5 < 10 < got[2].reading_level
    assert all(got[k].reading_level is None and got[k].n_sentences == 0 for k in (3, 4, 5)) and got[6].n_sentences == 1
    assert abs(sum(got[1].band_shares) - 1) < 1e-4 and got[1].n_sentences == 3
    assert R.reading_levels(df, model).count() == 7 and R.reading_levels(df.where("false"), model).count() == 0
    one = {r.key: r.reading_level for r in R.reading_levels(df.repartition(5), model).collect()}
    assert one == {k: r.reading_level for k, r in got.items()}


def test_no_grades(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="graded"):
        R.train(docs, spark.createDataFrame([(1, None)], "doc_id long, grade int"))
