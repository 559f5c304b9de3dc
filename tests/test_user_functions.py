import pytest

from tidemill.functions.columns import ColumnError
from tidemill.functions.user import create_rows, register_scalar, register_table
from tidemill.operators.project import create_feature


def test_scalar_function_in_an_expression(spark):
    def doubled(values):
        import pyarrow.compute as pc
        return pc.multiply(values, 2)

    register_scalar(spark, "doubled_value", doubled, "bigint")
    df = spark.createDataFrame([(1, 5), (2, None), (3, -4)], "i int, v bigint")
    made = create_feature(df, "w", "doubled_value(v) + 1").orderBy("i").collect()
    assert [r["w"] for r in made] == [11, None, -7]
    assert create_feature(df.limit(0), "w", "doubled_value(v)").count() == 0
    for taken in ("doubled_value", "upper"):
        with pytest.raises(ColumnError):
            register_scalar(spark, taken, doubled, "bigint")
    register_scalar(spark, "doubled_value", doubled, "bigint", replace=True)
    with pytest.raises(ColumnError):
        register_scalar(spark, "no name", doubled, "bigint")


def test_table_function(spark):
    class Letters:
        def eval(self, text):
            for i, letter in enumerate(text or ""):
                yield i, letter

    register_table(spark, "letters_of", Letters, "place int, letter string")
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (1, "ab")], ["i", "the text"])
    made = [tuple(r) for r in create_rows(df, "letters_of", ["the text"]).collect()]
    want = [(1, "ab", 0, "a"), (1, "ab", 1, "b")] * 2 + [(2, "", None, None), (3, None, None, None)]
    assert sorted(made, key=str) == sorted(want, key=str)
    assert create_rows(df, "letters_of", ["the text"], keep_empty=False).count() == 4
    with pytest.raises(ColumnError):
        create_rows(df.withColumnRenamed("i", "Place"), "letters_of", ["the text"])
    with pytest.raises(ColumnError):
        create_rows(df, "letters_of", ["nothing"])
