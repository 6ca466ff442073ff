from pyspark.sql import functions as F

from rankweave.functions import query_text as qt
from rankweave.operators.understand import understand_queries


def _uq(spark, lex, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")
    return {r["query_id"]: r for r in understand_queries(df, lex).collect()}


def test_clean_query_and_spellings(spark, ref_lex):
    u = _uq(spark, ref_lex, ["  Java   Script developer\n"])
    assert u[0]["q_clean"] == "JavaScript developer"
    assert u[0]["q_lower"] == "javascript developer"


def test_duration_forms(spark, ref_lex):
    texts = ["max 40 minutes", "about 30 mins", "2 hours", "1 hour 30 minutes", "30-40 minutes",
             "three people, 30 minutes", "duration: 25", "no time given", "about 45"]
    u = _uq(spark, ref_lex, texts)
    assert [u[i]["q_duration"] for i in range(len(texts))] == [40, 30, 120, 1800, 40, 1800, 25, None, 45]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    match = [r[0] for r in df.select(qt.query_duration(F.lower("t"), "match")).collect()]
    assert match == [40, 30, 120, 30, 40, 30, 25, None, 45]


def test_skills_roles_and_bag_of_categories(spark, ref_lex):
    u = _uq(spark, ref_lex, ["Java developer with numerical and verbal reasoning, consultant"])[0]
    assert u["skills"][:9] == ["java", "j2ee", "j2se", "jdk", "jvm", "spring", "hibernate", "core java", "automata"]
    assert "developer" in u["skills"] and "numerical" in u["skills"]
    assert len(u["skills"]) == len(set(u["skills"]))
    assert u["roles"] == ["developer", "consultant"]
    # categories are a bag: reasoning, verbal and numerical rules each add Ability & Aptitude
    assert u["tag_prefs"].count("Ability & Aptitude") == 4
    assert u["tag_prefs"][-3:] == ["Personality & Behavior", "Ability & Aptitude", "Competencies"]


def test_expand_query(spark, ref_lex):
    u = _uq(spark, ref_lex, ["senior python analyst"])[0]
    exp = u["expanded"]
    assert exp.startswith("senior python analyst ")
    assert exp == ("senior python analyst django flask pandas numpy data science experienced "
                   "experienced professional")
    assert " python " not in exp[len("senior python analyst"):]


def test_boost_tokens_cannot_match_punctuated_terms(spark, ref_lex):
    u = _uq(spark, ref_lex, ["C# and .NET with sql, Café"])[0]
    assert u["boost_tokens"] == ["sql"]
    assert "café" in u["q_words"]


def test_max_duration(spark):
    df = spark.createDataFrame([("takes 2 hours or 30 minutes",), ("1 hr 15 min",), ("none",)], "t string")
    got = [r[0] for r in df.select(qt.max_duration(F.col("t"))).collect()]
    assert got == [2, 1, None]
    got = [r[0] for r in df.select(qt.max_duration(F.col("t"), scale_hours=True)).collect()]
    assert got == [30, 15, None]
