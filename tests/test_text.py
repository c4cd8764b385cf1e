from pyspark.sql import functions as F

from docmine.functions import text as T


def values(spark, texts, col):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_variable_definition_needs_both(spark):
    texts = [
        "wherein R1 is methyl", "selected from the group consisting of halogen", "the R group only",
        "r2 selected from of", None, "",
    ]
    got = values(spark, texts, T.has_variable_definition(F.col("text")))
    assert got == [True, False, False, True, False, False]


def test_claim_preambles(spark):
    texts = ["What is claimed is:", "We claim: 1. A", "I claim nothing", "The following claims", "nothing"]
    assert values(spark, texts, T.starts_claims(F.col("text"))) == [True, True, False, True, False]
    old = T.starts_claims(F.col("text"), T.CLAIM_PREAMBLES_OLD)
    assert values(spark, ["intro\nClaims: 1", "reclaims x"], old) == [True, False]


def test_example_forms(spark):
    texts = [
        "Example 1a: synthesis of X", "synthesis of X", "  Preparation of  Y ", "see the synthesis of Z", None,
    ]
    assert values(spark, texts, T.example_name(F.col("text"))) == ["X", "X", "Y", None, None]
    assert values(spark, ["Example 12a: Preparation of z", "Example: x"], T.is_worked_example(F.col("text"))) == [
        True, False,
    ]


def test_labels_and_lists(spark):
    assert values(spark, ["R", "r1", "R1aXYZ9", "Ar", "", "Hal2"], T.is_valid_label(F.col("text"))) == [
        True, False, False, True, False, True,
    ]
    assert values(spark, [" a \n\n b", "", None], T.list_items(F.col("text"))) == [["a", "b"], [], []]
    assert values(spark, ["a/b/10.PDF", "x", ".hidden"], T.file_stem(F.col("text"))) == ["10", "x", ".hidden"]
