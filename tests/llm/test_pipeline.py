"""Every stage against a plain version of it, each on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from test_near_dedup import brute
from test_packing import brute_bins
from tokenizers import Tokenizer

from ledgerfold.llm import language_id, toxicity
from ledgerfold.llm.common import written
from ledgerfold.llm.textarrays import text_bytes

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_line_dedup(rows, min_chars=40, min_docs=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    docs_of = defaultdict(set)
    for k, text in rows:
        for line in (text or "").split("\n"):
            docs_of[key(line)].add(k)
    common = {x: max(ks) for x, ks in docs_of.items() if len(x) >= min_chars and len(ks) >= min_docs}
    return {k: "\n".join(line for line in (text or "").split("\n") if common.get(key(line), k) == k) for k, text in rows}


def test_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_001, None, "en", "s", None), (10_002, "", None, None, 0), (10_003, "12 34!", "en", "s", 6), (10_004, "long word " * 20_000, "en", "s", 200_000)]
    odd += [(20_000 + k, f"Words of number {k} stand here.\nthis line is shared by many documents and so it goes ", "en", "s", 80) for k in range(7)]
    docs = written(documents.unionByName(spark.createDataFrame(odd, documents.schema)), "with-odd")
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), "stage")
        stages[name] = (before, docs)
        if name != "packing":
            assert docs.columns == documents.columns

    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    score = lambda text: model.scores(*text_bytes(pa.array([text], pa.string())))[0]
    assert rows_of(after) == [r for r in rows_of(before) if score(r[1]) < 0.5]

    before, after = stages["language ID"]
    model = language_id.train(before)
    table = model.model.table(language_id.BITS)
    sure = lambda t: (lambda p: p[0][0] >= 0 and p[1][0] >= 0.5)(language_id.predict(table, model.model.bias, model.temperature, *text_bytes(pa.array([t], pa.string()))))
    assert rows_of(after) == [r for r in rows_of(before) if sure(r[1])]
    assert not {10_001, 10_002, 10_003} & {r.doc_id for r in after.collect()}

    before, after = stages["line dedup"]
    want = plain_line_dedup([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect() if 20_000 <= r.doc_id < 20_006)  # the last one keeps the line

    before, after = stages["near dedup"]
    classes = brute([(r.doc_id, re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == set(classes.values())

    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {r.doc_id: 1 + len(tokenizer.encode(r.text, add_special_tokens=False).ids) for r in before.collect()}
    got = defaultdict(int)
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == total
    lengths = [r.length for r in after.collect()]
    assert after.select("sequence_id").distinct().count() == len(brute_bins(lengths, 4096))


def test_stages_keep_columns_of_any_name(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["__n_dropped", "__N_lines", "__score", "__text", "__lang_pred", "__kept", "__text_hash", "__id", "class_id", "kept", "node"]
    docs = written(documents.select("*", *[F.lit(f"own {c}").alias(c) for c in names]), "clashing")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "clashing")
        assert docs.columns == [*documents.columns, *names], name
        rows = docs.select(*names).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(f"own {c}" for c in names)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_run_is_the_stages_in_a_row(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ends = out.groupBy("sequence_id").agg({"length": "sum"}).toPandas()
    assert np.all(ends["sum(length)"] <= 4096) and out.count() > 100
