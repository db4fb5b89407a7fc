from pyspark.sql import functions as F

from spanloom.functions import numeric, text


def tokens(spark, *texts, pattern=text.TOKEN):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return df, [r.t for r in df.select(text.tokenize(F.col("t"), pattern).alias("t")).collect()]


def test_tokens_with_offsets(spark):
    sample = "Spirit, spirit; man's—words."
    _, [found] = tokens(spark, sample)
    assert [(t.surface, t.folded) for t in found] == [("Spirit", "spirit"), ("spirit", "spirit"), ("man's", "man's"), ("words", "words")]
    assert all(sample[t.char_start : t.char_end] == t.surface for t in found)
    assert [t.position for t in found] == [0, 1, 2, 3]


def test_texts_without_tokens(spark):
    _, found = tokens(spark, "— ...", "", None, "  ")
    assert found == [[], [], [], []]


def test_both_tokenizers_agree(spark):
    texts = ["Ab cd—ef’gh ij.", None, "", "é日本 12,3 ’x’", "a\x01b", "don't stop 'now'", " x " * 50]
    df, cut = tokens(spark, *texts)
    rows = text.token_rows(df, "t").orderBy("k", "position").collect()
    for k, found in enumerate(cut):
        mine = [(t.position, t.surface, t.folded) for t in found]
        assert mine == [(r.position, r.surface, r.folded) for r in rows if r.k == k]


def test_apostrophe_rule(spark):
    row = spark.range(1).select(text.normalized(F.lit("man’s")).alias("n"), text.normalization_rules(F.lit("man’s")).alias("r"), text.normalization_rules(F.lit("man")).alias("none")).first()
    assert (row.n, row.r, row.none) == ("man's", ["typographic-apostrophe-equivalence"], [])


def test_composition(spark):
    df = spark.createDataFrame([("é",), (None,)], "t string")
    assert [r.t for r in df.select(text.nfc("t").alias("t")).collect()] == ["é", None]
    assert spark.range(1).select(text.fold(F.lit("K")).alias("x")).first().x == "k"


def test_numbers(spark):
    row = spark.range(1).select(
        numeric.round6(F.lit(0.0000005)).alias("half"), numeric.clamp(F.lit(1.5)).alias("one"), numeric.recursive_mean(F.array(F.lit(0.0), F.lit(1.0), F.lit(3.0))).alias("mean"),
        numeric.recursive_mean(F.array().cast("array<double>")).alias("none"), numeric.idf(F.lit(100), F.lit(10)).alias("idf"),
    ).first()
    assert (row.half, row.one, row.mean, row.none) == (1e-6, 1.0, 2.5, 0.0)
    assert abs(row.idf - 3.2172) < 1e-4
