"""The pipeline's stages against brute-force versions, each on its own input, and the guard around the subpackage."""

import hashlib
import os
import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voltmesh.llm import registry

from ..compare import connect, same
from . import brute
from .test_operators import expected_lines, token_counts_of


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage over a small corpus with copies, shared lines, junk and benchmark passages."""
    random.seed(11)
    vocabulary = [f"word{k}" for k in range(400)]
    line = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(k, line(20)) for k in range(3)]
    rows = [(k, "\n".join(line(15) for _ in range(random.randint(1, 4)))) for k in range(30)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200 + k, rows[k][1].replace("word1", "wort1", 1)) for k in range(5)]
    rows += [(300, None), (301, ""), (302, "same again " * 30), (303, items[0][1] + " " + line(5)), (304, line(60) + "\n" + items[1][1][:30])]
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(k, x, "en", f"s{k % 2}", len(x or "")) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, now, str(folder))
        made.write.parquet(f"{folder}/stage{k}")
        after = spark.read.parquet(f"{folder}/stage{k}")
        out.append((name, now.collect(), after.collect(), after.columns))
        now = after
    return out, items, corpus_pipeline.run(spark, str(folder)).collect()


def test_stage_columns(stages):
    for _, before, _, columns in stages[0][:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(stages):
    _, before, after, _ = stages[0][0]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not brute.quality(r.text)[-1]}


def test_line_stage(stages):
    _, before, after, _ = stages[0][1]
    want = Counter((d, text) for d, _, _, text in expected_lines([(r.doc_id, r.text) for r in before]))
    assert Counter((r.doc_id, r.text) for r in after) == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_simhash_stage(stages):
    _, before, after, _ = stages[0][2]
    prints = {r.doc_id: brute.fingerprint(r.text) for r in before}
    name = brute.closure(set(prints.values()), lambda a, b: bin(a ^ b).count("1") <= 2)
    low = {}
    for d, p in prints.items():
        low[name[p]] = min(low.get(name[p], d), d)
    assert {r.doc_id for r in after} == set(low.values()) and len(after) == len(low)


def test_simhash_stage_keeps_a_row_of_each_group(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (1, c), (1, d), (2, e), (None, e), (2, e), (3, None)]
    docs = spark.createDataFrame([(k, x, "en", "s", len(x or "")) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == Counter([(None, a), (None, b), (1, c), (1, d), (2, e), (3, None)])


def test_decontamination_stage(stages):
    _, before, after, _ = stages[0][3]

    def clean(text):
        n, hit, _ = brute.contamination(text, stages[1])
        return not (hit and 20 * hit >= n)

    assert {r.doc_id for r in after} == {r.doc_id for r in before if clean(r.text)}
    assert 303 not in {r.doc_id for r in after}


def test_token_stage_and_run(stages):
    _, before, after, columns = stages[0][4]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, *brute.encoded(t, r.text)) for r in before)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == want
    assert Counter((r.doc_id, r.ids_sha256) for r in stages[2]) == Counter((r.doc_id, r.ids_sha256) for r in after)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    same(spark, connect(sf_dir), registry.queries()[name], registry.oracle_sql()[name], sf_dir)


def test_queries_on_whole_tables(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = registry.queries()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found["op2_bpe"](spark, sf_dir).collect()} == {(d, *brute.encoded(t, x)) for d, x in docs.items()}
    rows = found["op9_simhash"](spark, sf_dir).collect()
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in rows} == {(d, brute.fingerprint(x)) for d, x in docs.items()}
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    name = brute.closure(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for d, x in prints.items():
        low[name[x]] = min(low.get(name[x], d), d)
    assert {(r.doc_id, r.component_id) for r in rows} == {(d, low[name[x]]) for d, x in prints.items()}
    rows = found["op8_token_counts"](spark, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens, r.n_pretokens) for r in rows} == {(d, *x) for d, x in zip(docs, token_counts_of(docs.values()), strict=True)}
    rows = found["op1_sharding"](spark, sf_dir).collect()
    assert {(r.doc_id, r.shard) for r in rows} == {(d, brute.jump(d, 40)) for d in docs}
    kept = found["op6_line_dedup"](spark, sf_dir).collect()
    want = {(d, n, gone, None if x is None else hashlib.sha256(x.encode()).hexdigest()) for d, n, gone, x in expected_lines(list(docs.items()))}
    assert {(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in kept} == want


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, tmp_path, k):
    """Null and repeated keys and rows, nulls in any column, empty texts and tables, and columns named like those that operators add."""
    rng = random.Random(k)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    a, b = text(), text()
    rows = [(None, a, None, None), (1, b, "en", "s"), (1, a[:200], "en", "s"), (1, b, "en", "s"), (2, None, None, "s"), (3, "", "en", None), (4, " \n\t", "en", "s"), (5, "lang " * 3000 + a, "en", "s")]
    odd = ["kept", "removed", "n_lines", "n_removed", "fp", "links", "component_id", "n_words", "n_hit", "items", "spans", "key", "doc", "no", "id", "group_id", "word", "n", "value", "rest", "class", "line", "host"]
    docs = spark.createDataFrame([(d, x, lang, s, len(x or "")) for d, x, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(j) if j % 3 else F.lit(None).cast("string") for j, c in enumerate(odd)})
    spark.createDataFrame([(1, text()), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, docs, str(tmp_path)).collect()
    columns = docs.columns if k < 4 else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == columns and empty.count() == 0
    assert len(got) == {0: 4, 1: 8, 2: 5, 3: 8, 4: 8}[k]
    assert all(r.removed == 1 and r.kept is None for r in got) if k < 4 else True
    if k < 4:
        assert all(r.n_chars == len(r.text or "") for r in got)
        assert {None, 1} <= {r.doc_id for r in got}


def test_the_rest_works_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin"})
    some = "grid_golden or gateway or entry or c07_wind or g12 or k01"
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "-k", some, "tests"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": os.pathsep.join(x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and Path(x).resolve() != root)}, capture_output=True, text=True)
    assert ran.returncode == 0 and " passed" in ran.stdout, ran.stdout[-2000:]


def test_registry_is_complete():
    names = set(registry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names - {"pipeline"}}
