"""Token alignment against whole texts cut by the libraries themselves."""

from collections import Counter

import public_tokenizers
import pytest

from voltmesh.llm import token_alignment

from . import brute

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "<|endoftext|> <s>x</s> <unk> <0x41> <|endoftext|>",
    "a▁b is not given back, and so has no tokens",
    " lead and trail ",
    "two  spaces\n\nlines \n x\ttab \x1c\x85   wide　space     end",
    "naïve Ωmega Привет мир 日本 語 🙂 🙂🙂 é “quoted words” — dash",
    "it's we'll don 't ' s 12 345 a1b2 ... !? \x00 nul",
    "\n", " ", "x", "﻿ bom", " 　 ",
]


def _rows(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("hot", [0, 7, 1 << 20])
def test_alignment(spark, hot):
    docs = brute.documents(spark).unionByName(spark.createDataFrame([(100 + k, x, "s", "z", 1) for k, x in enumerate(ODD)], "doc_id long, text string, source string, value string, n int"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = token_alignment.align(docs, A, B, hot=hot)
    assert got.columns[:4] == ["doc_id", "source", "value", "n"]
    assert _rows(got) == Counter(brute.alignment(rows, A, B))


def test_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert _rows(token_alignment.align(docs, A, B)) == Counter(brute.alignment([tuple(r) for r in docs.collect()], A, B))


def test_memory_of_units_and_long_texts_in_parts(spark, monkeypatch):
    long = " ".join(f"word{k % 977} next\n{k % 31}" for k in range(3000))
    docs = [("a", long), ("b", long + " a▁b"), ("c", "▁ " + long), ("d", "x" * 3000), ("e", "end")]
    want = brute.alignment(docs, A, B)
    monkeypatch.setattr(token_alignment, "SLICE", 1000)
    monkeypatch.setattr(token_alignment, "UNITS", 50)
    monkeypatch.setattr(token_alignment, "_made", {})
    import pyarrow as pa

    aligner = token_alignment.Aligner(A, B)
    for (_, text), (_, n_a, n_b, n_groups, n_links, *_) in zip(docs, want, strict=True):
        sums = Counter()
        broken, parts = False, 0
        for _, _, table, codes in token_alignment._parts(pa.RecordBatch.from_pydict({"text": [text]}), "text", aligner):
            parts += 1
            got = table.take(pa.array(codes)).to_pydict()
            broken |= not all(got["whole"])
            sums += Counter({c: sum(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")})
        assert len(aligner.known) <= 50 and (parts > 3 or len(text) < 5000)
        assert broken == ("▁" in text)
        assert broken or (sums["n_a"], sums["n_b"], sums["n_groups"], sums["n_links"]) == (n_a, n_b, n_groups, n_links)


def test_empty_table_text_of_groups_and_clashes(spark):
    docs = brute.documents(spark, extra=False)
    assert token_alignment.align(docs.limit(0), A, B).count() == 0
    assert token_alignment.pair_counts(docs.limit(0), A, B).count() == 0
    rows = token_alignment.align(spark.createDataFrame([(1, "an anhely")], "doc_id long, text string"), A, B, digest=False).collect()
    sides = [g.split("|") for g in rows[0].groups.split(";")]
    assert sum(len(x.split(",")) for x, _ in sides) == rows[0].n_a and sum(len(y.split(",")) for _, y in sides) == rows[0].n_b
    with pytest.raises(ValueError):
        token_alignment.align(docs.selectExpr("*", "1 as n_a"), A, B)


def test_a_text_longer_than_a_slice(spark):
    words = ["anhely", "eran,", "naïve", "x1", "don't"]
    docs = [(1, " ".join(words[k * k % 5] + str(k % 89) for k in range(token_alignment.SLICE // 6))), (2, "anhely eran"), (3, "eran " + "xyz" * 200_000 + " anhely")]
    assert len(docs[0][1].encode()) > token_alignment.SLICE
    got = token_alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), A, B)
    assert _rows(got) == Counter(brute.alignment(docs, A, B))
