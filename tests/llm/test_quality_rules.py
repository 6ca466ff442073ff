import re
from collections import Counter

from rankweave.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def test_counts_match_brute_force(spark, hard_docs):
    more = [(100, "a b c a b c x\na b c\na b c\n\n", None, "h"), (101, "a a a a a", None, "h"), (102, "a b c", None, "h"),
            (103, "#|<> & $x\r\n*%", None, "h"), (104, "x y " * 40, None, "h")]
    docs = hard_docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(more, "a long, b string, c string, d string"))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted(((r.doc_id, *[r[c] for c in cols]) for r in Q.quality_rules(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=repr)


def test_bad_hosts_lose_their_good_documents(spark, no_docs):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(h * 100 + k, "short" if (k < 9 if h == 0 else k < 1) else f"{good} {h}-{k}", f"h{h}") for h in range(8) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    assert not out[9].kept and not out[9].base_failed  # the only good text of a bad host
    assert out[109].kept and not out[100].kept
    assert out[9].host_rate < 0.9  # shrunk towards the others
    assert Q.quality_rules(no_docs).count() == 0


def test_one_host_keeps_its_rate(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "b " * 3, None)], "doc_id long, text string, source string")
    assert [r.kept for r in Q.quality_rules(docs).collect()] == [False, False]
