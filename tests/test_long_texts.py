"""Query understanding over whole documents: what is skipped doesn't change results."""
import random
import re

from pyspark.sql import functions as F

from rankweave.functions import query_text as qt
from rankweave.functions.lexicon import reference_lexicon

LEX = reference_lexicon()
PIECES = ["java script", "core java", "Java", "min", "max 30", "about", "12", "hrs", "minutes", "mins", "duration: 7", " ", "  ", "\t", "\n \n", " ", "  ",
          "ünï", "vue", "node", "nodes", "c#", "sql server", "x", "seniority", "an hour", "3 hour"]


def _texts(n):
    rng = random.Random(7)
    return [None, "", " ", "　"] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_terms_that_decide():
    assert qt.deciding(("java", "j2ee", "core java", "java", "java script")) == ["java", "j2ee"]
    assert qt.deciding(("a", "b")) == ["a", "b"] and qt.deciding(("", "a")) == [""] and qt.deciding(()) == []
    for terms in (t for _, t in (*LEX.concepts, *LEX.roles)):
        for text in _texts(50)[1:]:
            assert any(t in text for t in qt.deciding(terms)) == any(t in text for t in terms)


def test_long_texts_give_what_python_gives(spark):
    texts = _texts(400)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, q string")
    low = F.col("low")
    out = df.withColumn("clean", qt.clean_query(F.col("q"))).withColumn("low", F.lower("clean")).select(
        "k", "clean", qt.query_duration(low).alias("minutes"), qt.query_skills(low, LEX).alias("skills"), qt.boost_tokens(low, LEX).alias("tokens"))
    for r in out.collect():
        text = texts[r.k]
        if text is None:
            assert r.clean is None and r.minutes is None and r.tokens is None
            continue
        clean = " ".join(text.split())
        for a, b in qt.JOINED_SPELLINGS:
            clean = clean.replace(a, b)
        low_text = clean.lower()
        skills = [v for _, vs in LEX.concepts if any(v in low_text for v in vs) for v in vs]
        found = [m for m in (re.search(p, low_text) for p in qt.DURATION_PATTERNS) if m]
        minutes = int(found[0][1]) * (60 if "hour" in low_text or "hr" in low_text else 1) if found else None
        assert (r.clean, r.skills, r.minutes) == (clean, list(dict.fromkeys(skills)), minutes)
        assert r.tokens == sorted(set(re.findall(r"\w+", low_text)) & set(LEX.token_terms))
