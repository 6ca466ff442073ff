import importlib.util
import subprocess
import sys
from pathlib import Path

import public_tokenizers
from test_jaccard_join import brute
from tokenizers import Tokenizer

import corpus_pipeline as C
from rankweave.llm import language_id, mix_sources
from rankweave.llm import queries as Q

REPO = Path(__file__).resolve().parents[2]


def test_stages_in_order_take_effect(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
    assert [n for n, _ in C.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "pack"]
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    packed = spark.read.parquet(str(tmp_path / "pack"))
    mixed = spark.read.parquet(str(tmp_path / "mix"))
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in mixed.select("doc_id").distinct().collect()}


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(spark, docs, verdicts):
    """{(doc_id, text): times} after the first four stages, in plain Python; language verdicts are given, and the copies that
    the mix takes of the documents that this found."""
    rows = [r for r in docs.collect() if (r.doc_id, r.text) in verdicts]
    rank = lambda r: (r.doc_id is not None, r.doc_id)
    by_text = {}
    for r in rows:
        key = _lower(r.text)
        if key not in by_text or rank(r) > rank(by_text[key]):
            by_text[key] = r
    rows = list(by_text.values())
    components = {}
    for k, n, c in brute([(k, r.text) for k, r in enumerate(rows)]):
        components.setdefault(c if n else ("blank", k), []).append(rows[k])
    smallest = lambda rs: min(rs, key=lambda r: (r.doc_id is not None, r.doc_id if r.doc_id is not None else 0))
    rows = [smallest(rs) for rs in components.values()]
    taken = mix_sources.mixed_documents(spark.createDataFrame(rows, docs.schema)) if rows else docs.limit(0)
    out = {}
    for r in taken.collect():
        out[r.doc_id, r.text] = out.get((r.doc_id, r.text), 0) + 1
    return out


def same_pieces(spark, folder):
    """run() gives each document that plain Python keeps, whole, as often as it is taken, and nothing else."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    verdicts = {(r.doc_id, r.text) for r in language_id.known_language(docs).collect()}
    want, tokenizer = {}, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for (doc_id, text), times in plain(spark, docs, verdicts).items():
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        want[doc_id, n] = want.get((doc_id, n), 0) + times * n
    got = {}
    for r in C.run(spark, folder).collect():
        got[r.doc_id, r.doc_tokens] = got.get((r.doc_id, r.doc_tokens), 0) + r.length
    assert got == want
    return want


def test_run_against_plain_python(spark):
    assert len(same_pieces(spark, "/root/testdata/sf0.001")) > 50


def test_run_on_hard_rows(spark, hard_docs, no_docs, tmp_path):
    hard_docs.write.parquet(f"{tmp_path}/hard/documents.parquet")
    kept = same_pieces(spark, f"{tmp_path}/hard")
    assert kept and not {3, 4, 5, 10} & {i for i, _ in kept}       # no letter, no language
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    out = C.run(spark, f"{tmp_path}/none")
    assert out.count() == 0 and "ids_crc32" in out.columns


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.JOBS) == list(range(1, 14)) and set(Q.SQL) <= set(Q.JOBS)


def test_nothing_else_needs_the_package(tmp_path):
    """A copy of the repository without these folders still imports and has its other queries."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-3]) > 90 and out[-2:] == ["False", "False"]
    assert importlib.util.find_spec("rankweave.llm")
