import math

from pyspark.sql import functions as F

from tonemill.functions import identity, sentiment, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_noise_and_lookup_key(spark):
    assert one(spark, "a-b+c^d:e", text.strip_noise(F.col("t"))) == "abcde"
    assert one(spark, "Ex_cé1l", text.lookup_key(F.col("t"))) == "excl"


def test_sentences_drop_blanks(spark):
    assert one(spark, "One. . two!\n three?", text.sentences(F.col("t"))) == ["One", " two", " three"]
    assert one(spark, "", text.sentences(F.col("t"))) == []


def test_lookup_words_equal_cleaning_each_word(spark):
    sample = "Éa réal-time 12 x1y ñandú good, été"
    by_word = [w for w in one(spark, sample, F.transform(text.letter_words(F.col("t")), text.lookup_key)) if w]
    assert [w for w in one(spark, sample, text.lookup_words(F.col("t"))) if w] == by_word


def test_words(spark):
    assert one(spark, "The I.B.M. owner's dog's-toy don't 4x4 café", text.words(F.col("t"))) == [
        "the", "ibm", "owner", "dog", "toy", "don't", "4x4", "café",
    ]
    assert one(spark, "a1's abc's5 it’s", text.words(F.col("t"))) == ["a1", "s", "abc", "5", "it"]


def test_words_of_a_very_long_run(spark):
    assert one(spark, "a." * 50_000, F.size(text.words(F.col("t")))) == 1
    assert one(spark, "b'" * 50_000, F.size(text.words(F.col("t")))) == 1


def test_shingles_keep_pairs_with_stop_words(spark):
    df = spark.createDataFrame([(["the", "good", "x"],)], "w array<string>")
    assert df.select(text.shingles(F.col("w"))).first()[0] == ["good", "the good", "good x"]
    assert df.select(text.word_ngrams(F.col("w"))).first()[0] == [
        "the", "good", "x", "the good", "good x", "the good x",
    ]
    empty = spark.createDataFrame([([],), (["one"],)], "w array<string>")
    assert [r[0] for r in empty.select(text.word_ngrams(F.col("w"))).collect()] == [[], ["one"]]


def test_char_ngrams_and_windows(spark):
    assert one(spark, "aé b", text.char_ngrams(F.col("t"), 1, 3)) == [
        "a", "é", " ", "b", "aé", "é ", " b", "aé ", "é b",
    ]
    assert one(spark, "a😀b", text.char_ngrams(F.col("t"), 2, 2)) == ["a😀", "😀b"]
    assert one(spark, "ab\nc", text.char_ngrams(F.col("t"), 4, 4)) == ["ab\nc"]
    assert one(spark, "ab", text.char_ngrams(F.col("t"), 3, 3)) == []
    assert one(spark, "ab", text.prefixes(F.col("t"), 1, 3)) == ["a", "ab"]


def test_score_class_edges(spark):
    cases = {
        0.75: "strong_positive", 0.7499: "positive", 0.2501: "positive", 0.25: "weak_positive", 0.0: "neutral",
        -0.25: "weak_negative", -0.2501: "negative", -0.7499: "negative", -0.75: "strong_negative",
        None: "neutral", math.nan: "neutral",
    }
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, s double")
    got = [r["c"] for r in rows.orderBy("i").select(sentiment.score_class(F.col("s")).alias("c")).collect()]
    assert got == list(cases.values())


def test_overall_class(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([-1, 0, 1, 2, 3, 4])], "i int, n int")
    got = [r[0] for r in rows.orderBy("i").select(sentiment.centred_class(F.col("n"))).collect()]
    assert got == [0, -2, -1, 0, 1, 2]


def test_small_functions(spark):
    assert one(spark, "abcdef", text.truncate(F.col("t"), 3, "..")) == "abc.."
    assert one(spark, "abc", text.truncate(F.col("t"), 3, "..")) == "abc"
    assert one(spark, "     ", text.truncate(F.col("t"), 3, "..")) == "     "
    assert one(spark, "61101", text.elapsed(F.col("t").cast("long"))) == "1 min 1 sec 101 ms"
    assert one(spark, "a/b\\c:d", text.clean_name(F.col("t"))) == "a_b_c_d"
    assert one(spark, " <a b>\n", text.escape_markup(F.col("t"))) == (
        '<html><body><pre id="content">&lt;a&nbsp;b&gt;</pre></body></html>'
    )


def test_domains(spark):
    assert one(spark, "  ", identity.domain_or_default(F.col("t"))) == "$DEF"
    assert one(spark, "a, b,,a", identity.domain_list(F.col("t"))) == ["a", "b", "$DEF"]
    assert one(spark, None, identity.domain_list(F.col("t"))) == ["$DEF"]


def test_model_id_ignores_row_order_and_splits(spark):
    rows = [("d", "gaussian_nb", "pos", "f", 3, 0.1), ("d", "gaussian_nb", "neg", "f", 2, 0.25)]
    schema = "domain string, algorithm string, label string, feature string, n long, mean double"

    def ids(data, parts):
        df = spark.createDataFrame(data, schema).repartition(parts)
        return identity.model_ids(df, ["domain", "algorithm"], ["label", "feature"], ["n", "mean"]).first()["model_id"]

    assert ids(rows, 1) == ids(rows[::-1], 4)
    assert ids(rows, 1) != ids(rows[:1], 1)


def test_model_id_ignores_the_noise_of_sums(spark):
    # The squares of three rows, added up in two orders: a tie of six decimals but for its noise.
    def id_of(m2):
        df = spark.createDataFrame([("en", "a", "neg", "x", 3, 0.1, m2)], "domain string, algorithm string, label string, feature string, n long, mean double, m2 double")
        return identity.model_ids(df, ["domain", "algorithm"], ["label", "feature"], ["n", "mean", "m2"]).first()["model_id"]

    assert id_of(0.010212499999999998) == id_of(0.010212500000000001) == id_of(0.0102125)
    assert id_of(-0.010212499999999998) == id_of(-0.010212500000000001)
    assert id_of(0.010212) != id_of(0.0102125)
    # A large number a little below a tie is none.
    assert id_of(472758.3335784875) == id_of(472758.333578)
