"""The pipeline against a brute-force version of its stages."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken
import corpus_pipeline
from turnstone.llm.tree_bpe import ranks_of

from .conftest import clashing
from .test_documents import brute_join, brute_lines


def brute(rows):
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    rows = [(i, t) for i, _, _, t in brute_lines(rows)]
    kept, seen = [], set()
    for (i, t), (_, _, c) in zip(rows, brute_join(rows), strict=True):
        if i == c and (i, t) not in seen:
            kept.append((i, t))
            seen.add((i, t))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    return sorted((i, len(x), hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept for x in [enc.encode_ordinary(t)])


def test_pipeline(docs, spark, texts, tmp_path):
    df = clashing(docs.union(docs.limit(2)))
    names = df.columns
    now = df
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == names, name
            now.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in now.collect())
    assert got == brute([*enumerate(texts), *((r.doc_id, texts[r.doc_id]) for r in docs.limit(2).collect())])


def test_run(docs, empty_docs, spark, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "some/documents.parquet"))
    empty_docs.write.parquet(str(tmp_path / "none/documents.parquet"))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect())
    assert got == brute(list(enumerate(texts)))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_language_is_what_is_found(spark, tmp_path):
    """Labels of the fold that isn't learned from have no say, a few words are enough to stay."""
    words = {"en": "the and of that with this from have", "de": "der und nicht werden ich sie mit auch"}
    rows = [(i, " ".join(words["en" if i % 2 else "de"].split()[k % 8] for k in range(i, i + 40)), "en" if i % 2 else "de", "a", 1) for i in range(60)]
    rows = [(*r[:2], "xx" if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[2], *r[3:]) for r in rows] + [(100, "und", None, "a", 1), (101, "12 ..", "en", "a", 1), (102, None, "en", "a", 1)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(60)} | {100: "de"}


def test_rows_follow_the_mix(spark, tmp_path):
    from turnstone.llm.pfair_mix import mix_sources

    rows = [(i, f"document {i} " + f"word{i} " * (1 + 4000 * (i % 7 == 0) * (i < 60)), "en", ["a", "b", "c"][i % 5 % 3], 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    corpus_pipeline.mixing(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.byte_bpe(spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).collect()
    assert {r.doc_id: r.mix_position for r in got} == {r.doc_id: r.mix_position for r in mix_sources(docs).collect()}
