"""The pipeline against a brute-force version of its stages, and its edge cases."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from shopmetrics.llm.queries import oracle_sql, piece_model, queries

from .conftest import DOCS
from .test_decontaminate import plain as plain_hits
from .test_line_dedup import plain as plain_lines
from .test_simhash import plain_components, plain_fingerprint


def write(spark, folder, docs, bench):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def brute(docs, bench):
    docs = [(i, t) for i, t, *_ in docs if t is not None and any(c.isalpha() for c in t)]
    lines = plain_lines(docs)
    docs = [(i, lines[i][3]) for i, _ in docs]
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    comp = plain_components(fps)
    keep = {i for i, f in fps if comp[f] == i}
    docs = [(i, t) for i, t in docs if i in keep]
    out = {}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for i, t in docs:
        words, hit, _, _ = plain_hits(t, bench, 13)
        if hit and 20 * hit >= words:
            continue
        ids = sp.encode(t, add_eos=True)
        out[i] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), sp.decode(ids))))
    return out


def corpus(rng):
    def say(n): return " ".join("".join(rng.choice(["the", "er", "ing", "on", "é", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    bench = [(k, say(20)) for k in range(5)] + [(9, None)]
    shared = "\n".join(say(8) for _ in range(4))
    texts = [None, "", "12 34", "...", "word"]
    for k in range(40):
        t = "\n".join(say(rng.randint(5, 25)) for _ in range(rng.randint(1, 6)))
        if k % 5 == 0:
            t += "\n" + shared
        if k % 7 == 0:
            t += "\n" + bench[k % 5][1]
        texts += [t] * (1 + (k % 6 == 0))
        if k % 8 == 0:
            texts.append(t + " end")
    return [(i, t, rng.choice(["en", "de", None]), "src0", None if t is None else len(t)) for i, t in enumerate(texts)], bench


def test_equals_brute_force(lspark, tmp_path):
    docs, bench = corpus(random.Random(12))
    out = cp.run(lspark, write(lspark, tmp_path, docs, bench)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out} == brute(docs, bench)


def test_stages_keep_columns_and_survive_odd_tables(lspark, tmp_path):
    docs = [(1, "a b c", "en", None, 5), (1, "a b c", "en", None, 5), (None, "x y", None, "s", None), (2, None, None, None, None)]
    folder = write(lspark, tmp_path, docs, [(1, "q")])
    frame = lspark.read.parquet(f"{folder}/documents.parquet").withColumn("id", F.lit("x")).withColumn("found_lang_pred", F.lit(1))
    for _, stage in cp.STAGES[:-1]:
        assert stage(lspark, frame, folder).columns == frame.columns
        assert stage(lspark, frame, folder).count() >= 1
        assert stage(lspark, frame.where("false"), folder).collect() == []
    assert cp.STAGES[-1][1](lspark, frame.where("false"), folder).collect() == []


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run_on_empty_tables(lspark, tmp_path, name):
    folder = write(lspark, tmp_path, [], [])
    lspark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    lspark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    lspark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    assert queries()[name](lspark, folder).collect() == []


def test_lettered_texts_stay_without_a_model(lspark, make_docs):
    docs = make_docs(["the end", None, "", "12 ?!", "дом", "a1"], lang=None)
    kept = cp.language_id(lspark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4, 5]
