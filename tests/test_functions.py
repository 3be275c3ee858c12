import math

from pyspark.sql import functions as F

from stakelens.functions import names, odds
from stakelens.functions import typing as t
from stakelens.operators.cuts import odds_band, odds_bucket
from stakelens.operators.grading import result_wins


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(F.col("i"), expr("v").alias("r")).orderBy("i").select("r").collect()]


def test_unit_profit(spark):
    rows = [(150, True), (-200, True), (-200, False), (0, True), (None, True), (150, None)]
    df = spark.createDataFrame(rows, "o int, w boolean")
    got = [r[0] for r in df.select(odds.unit_profit("w", "o")).collect()]
    assert got == [1.5, 0.5, -1.0, None, None, None]


def test_implied_and_decimal(spark):
    assert column(spark, [100, -150], "int", odds.implied_prob) == [0.5, 0.6]
    assert column(spark, [1.0, 1.5, 2.0, 2.5, 2.125, None], "double", odds.decimal_to_american) == [
        None, -200, 100, 150, 112, None,
    ]


def test_lenient_casts(spark):
    values = ["1.5", "+150", " 7 ", "abc", None]
    assert column(spark, values, "string", t.try_int) == [None, 150, 7, None, None]
    assert column(spark, values, "string", t.try_double) == [1.5, 150.0, 7.0, None, None]
    assert column(spark, ["T", "1", "True", "0", None], "string", t.truthy) == [True, True, True, False, None]
    assert column(spark, ["T", "f", None], "string", t.not_flagged) == [False, True, True]
    assert column(spark, ["+1.5", "-1.5", "x"], "string", t.signed_number) == [1.5, -1.5, None]


def test_innings(spark):
    values = ["5", "5.1", "5.2", "5.3", None, "x"]
    assert column(spark, values, "string", t.innings_to_outs) == [15, 16, 17, 15, 0, 0]


def test_names(spark):
    values = ["José Núñez", "  ZOË\t", None, "Ødegård", "é"]
    assert column(spark, values, "string", names.norm_name) == ["jose nunez", "zoe", None, "ødegard", "e"]
    assert column(spark, values, "string", names.norm_name_full) == ["jose nunez", "zoe", None, "ødegard", "e"]
    flipped = column(spark, ["Núñez, José", "plain name"], "string", names.norm_last_first)
    assert flipped == ["jose nunez", "plain name"]


def test_bucket_edges(spark):
    values = [-251, -250, -249, -150, -149, -101, -100, 0, 99, 100]
    buckets = column(spark, values, "int", odds_bucket)
    assert buckets == ["<=-250", "-150..-249", "-150..-249", "-100..-149", "-100..-149", "-100..-149",
                       "-100..-149", "-100..-149", "-100..-149", "plus"]
    bands = column(spark, values, "int", odds_band)
    assert bands == ["<=-250", "<=-250", "-249..-150", "-249..-150", "-149..-101", "-149..-101", None, None, None, "plus"]


def test_push_loses_both_sides(spark):
    df = spark.createDataFrame([(2, 2.0, "over"), (2, 2.0, "under"), (3, 2.0, "over"), (3, None, "over")], "s int, l double, d string")
    loss = [r[0] for r in df.select(result_wins(F.col("s"), F.col("l"), F.col("d"))).collect()]
    void = [r[0] for r in df.select(result_wins(F.col("s"), F.col("l"), F.col("d"), push="void")).collect()]
    assert loss == [False, False, True, False]
    assert void == [None, None, True, False]


def test_rating_prob(spark):
    assert math.isclose(column(spark, [0.0], "double", odds.rating_prob)[0], 0.5)


def test_names_fold_as_full_decomposition_does(spark):
    import unicodedata

    values = ["Nguyễn", "Йован", "Άρης", "ﬁeld", "Ĳsbrand", "Ｊosé", "Zoë", "ødegård", "Ꞩa", "plain", " ½ ﬃ ", None]

    def plain(s):
        kept = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return kept.strip().lower()

    got = column(spark, values, "string", names.norm_name)
    assert got == [None if v is None else plain(v) for v in values]


def test_name_keys_know_every_script(spark):
    import unicodedata

    values = ["각하 김", "ｱ 𝐁𝐨𝐛", "कुमार", "é", "José ", "JOSE", " plain\t", "Ðorđe", "ﷺ", "", None, "José "]
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "who string, _name int")

    def plain(s):
        kept = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return kept.strip(" \t\n\r\x0b\x0c").lower()

    got = names.name_keys(frame.withColumnRenamed("_name", "i"), "who").orderBy("i").collect()
    assert [r.name_norm for r in got] == [None if v is None else plain(v) for v in values]
    # marks of class 0 stay in both forms
    assert column(spark, ["कुमार", "é"], "string", names.norm_name) == [plain("कुमार"), "e"]


def test_latin_names_meet_no_lookup(spark, monkeypatch):
    """Names with accents are folded in place, so the lookup table stays empty however many there are."""
    from stakelens.operators import ordered

    met, join = [], ordered.lookup_join
    monkeypatch.setattr(ordered, "lookup_join", lambda rows, small, on, how="inner": met.append(small.count()) or join(rows, small, on, how))
    who = ["José Núñez 7", " Zoë MÜLLER", "e\u0301", "Łukasz", "Ǆ", "\u00a0ñ\u00a0", "ő\u034f", "Иван", None, "", "K\u212a", "ﬁn", "µ", "½"]
    frame = spark.createDataFrame(list(enumerate(who)), "i int, who string")
    got = [r.name_norm for r in names.name_keys(frame, "who").orderBy("i").collect()]
    assert got == [names.fold_name(w) for w in who]
    assert met == [8]
    many = spark.range(500).select(F.concat(F.lit("Zoë Ñandú "), F.col("id")).alias("who"))
    assert names.name_keys(many, "who").select("name_norm").distinct().count() == 500 and met[1:] == [0]
