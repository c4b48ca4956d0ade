from pyspark.sql import functions as F

from memberlens.functions import codes
from memberlens.functions import expr as x
from tests.helpers import d, rows, table


def one(spark, value, schema):
    return spark.createDataFrame([(value,)], schema)


def test_available_from_matches_the_lag_rule(spark):
    days = spark.sql("SELECT explode(sequence(date'2023-01-01', date'2025-03-31', interval 1 day)) AS e")
    for lag in (2, 4):
        checked = days.withColumn("first", x.available_from("e", lag)).select(
            (F.add_months("first", -lag) >= F.col("e")).alias("seen"),
            (F.add_months(F.date_sub("first", 1), -lag) < F.col("e")).alias("not_before"))
        assert checked.where("NOT seen OR NOT not_before").count() == 0


def test_month_and_year_boundaries(spark):
    df = spark.createDataFrame([(d("2024-01-31"), d("2024-02-01")), (d("2000-12-31"), d("2023-01-01")), (None, d("2023-01-01"))], "a date, b date")
    got = df.select(x.months_crossed("a", "b"), x.years_crossed("a", "b")).collect()
    assert [tuple(r) for r in got] == [(1, 0), (265, 23), (None, None)]


def test_weekday_counts_from_sunday(spark):
    got = spark.sql("SELECT date'2024-09-01' AS d").select(x.weekday_from_sunday("d")).first()[0]
    assert got == 0


def test_codes_lose_dots_and_case(spark):
    got = one(spark, " e11.9 ", "c string").select(x.normalised_code("c")).first()[0]
    assert got == "E119"


def test_group_flags_and_other(spark):
    df = spark.createDataFrame([(36,), (155,), (999,), (None,)], "c int")
    got = table(df.select("c", *x.group_flags("c", codes.CONDITION_GROUPS, "has_", other="other")), "c", "has_diabetes", "has_mental_health", "has_other")
    assert got == {36: (1, 0, 0), 155: (0, 1, 0), 999: (0, 0, 1), None: (0, 0, 0)}
    named = table(df.select("c", x.group_name("c", codes.CONDITION_GROUPS, "other").alias("g")), "c", "g")
    assert named == {36: "diabetes", 155: "mental_health", 999: "other", None: None}


def test_one_hot_other_takes_null_and_unknown(spark):
    df = spark.createDataFrame([("a b",), ("z",), (None,)], "m string")
    got = table(df.select("m", *x.one_hot("m", ["a b"], "is_")), "m", "is_a_b", "is_other")
    assert got == {"a b": (1, 0), "z": (0, 1), None: (0, 1)}


def test_prefix_flags_are_zero_for_null(spark):
    df = spark.createDataFrame([("abd plus",), ("tanf",), ("x",), (None,)], "c string")
    got = table(df.select("c", *x.prefix_flags("c", codes.PRODUCT_PREFIXES)), "c", "is_abd", "is_tanf", "is_other")
    assert got == {"abd plus": (1, 0, 0), "tanf": (0, 1, 0), "x": (0, 0, 1), None: (0, 0, 0)}


def test_bands_and_open_top(spark):
    df = spark.createDataFrame([(15,), (19,), (20,), (100,), (None,)], "a int")
    got = table(df.select("a", x.band_start("a", 5).alias("b"), *x.band_flags("a", 15, 100, 5, "is_")), "a", "b", "is_15_19", "is_20_24", "is_100_plus")
    assert got == {15: (15, 1, 0, 0), 19: (15, 1, 0, 0), 20: (20, 0, 1, 0), 100: (100, 0, 0, 1), None: (None, 0, 0, 0)}


def test_encounter_rules(spark):
    df = spark.createDataFrame([("23", None), ("11", "0456"), ("21", None), (None, "0110"), ("11", "0214"), ("11", "0300"), (None, None)], "p string, r string")
    got = rows(df.select("p", "r", x.is_ed_line("p", "r"), x.is_ip_line("p", "r")))
    want = [("23", None, True, False), ("11", "0456", True, False), ("21", None, False, True), (None, "0110", False, True),
            ("11", "0214", False, True), ("11", "0300", False, False), (None, None, False, False)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_priority_first_rule_wins(spark):
    df = spark.createDataFrame([(True, True), (False, True), (None, None)], "e boolean, s boolean")
    got = [r[0] for r in df.select(x.engagement_group("e", "s")).collect()]
    assert got == ["engaged_in_program", "selected_not_engaged", "not_selected_for_engagement"]


def test_dates_fall_back(spark):
    df = spark.createDataFrame([(d("2024-01-05"), d("2024-01-01")), (d("2030-01-01"), d("2024-01-02")), (None, d("2024-01-03"))], "a date, b date")
    got = [r[0] for r in df.select(x.date_or_fallback("a", "b", F.lit("2024-06-01").cast("date"))).collect()]
    assert got == [d("2024-01-05"), d("2024-01-02"), d("2024-01-03")]


def test_small_helpers(spark):
    df = spark.createDataFrame([("", " ", 2.0, 0.0, None, 1)], "a string, b string, n double, z double, l int, m int")
    got = df.select(x.first_filled("a", "b"), x.ratio("n", "z"), x.either("l", "m"), x.at_least("n", 2),
                    x.three_state(F.col("n") > 5, F.col("n") > 1), x.gated(F.col("n") > 5, "n"),
                    x.fill_template(F.lit("{{A}}-{{B}}"), {"A": F.lit("x"), "B": F.lit("y")}), x.synonym("a", ["ed"])).first()
    assert tuple(got) == (" ", None, 1, 1, 0, None, "x-y", False)


def test_age_is_null_before_birth(spark):
    df = spark.createDataFrame([(d("2000-01-01"), d("2010-01-01")), (d("2011-01-01"), d("2010-01-01"))], "b date, a date")
    got = [r[0] for r in df.select(x.age_in_years("b", "a")).collect()]
    assert abs(got[0] - 3653 / 365.25) < 1e-12 and got[1] is None


def test_frame_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, "t", True)], "ID int, y_a double, Txt string, B boolean")
    kept, skipped = x.numeric_features(df, exclude=["id"], exclude_prefixes=["q"])
    assert kept == ["y_a"] and skipped == ["Txt", "B"]
    assert x.aligned(df, ["y_a", "zz"]).first() == (2.0, 0)
    assert x.as_doubles(df, ["b", "id"]).first() == (1.0, 2.0, "t", 1.0)
