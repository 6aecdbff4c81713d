"""The registered queries of the operators and the pipeline, on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from signalbox.llm import mixing, secret_scan
from signalbox.llm.queries import MIX_TARGETS, QUERIES, SQL
from tests.compare import connect, differences
from tests.llm import brute

SF_DIR = os.environ.get("SIGNALBOX_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def rows(spark, name):
    return contract.queries()[name](spark, SF_DIR).collect()


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= {*contract.queries()}
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert differences(contract.queries()[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) == []


def test_scores_cover_every_document_and_hold_folds_out(spark, documents):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    for name, folds, fold in (("op1_toxicity", 5, 0), ("op4_language_mixture", 4, 2)):
        found = rows(spark, name)
        assert sorted(r.doc_id for r in found) == sorted(documents)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 for r in found)
        if folds == 4:
            assert sum(r.lang_pred == documents[r.doc_id].lang for r in found if r.held_out) >= 0.95 * sum(r.held_out for r in found)
        else:
            assert sum(r.predicted == labels[r.doc_id] for r in found if r.doc_id in labels) >= 0.9 * sum(r.doc_id in labels for r in found)


def test_join(spark, documents):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op5_ngram_jaccard_join")}
    plain = brute.jaccard_components([(i, r.text) for i, r in documents.items()])
    assert found == {i: (len(brute.shingle_set(r.text)), plain[i]) for i, r in documents.items()}


def test_licenses(spark, documents):
    for r in rows(spark, "op6_license_scan"):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(documents[r.doc_id].text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_secrets(spark, documents):
    for r in rows(spark, "op7_secret_scan"):
        spans = brute.secret_base(documents[r.doc_id].text)
        listed = ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("literal")] == [s for s in listed.split(",") if s]


def test_quality(spark, documents):
    for r in rows(spark, "op8_quality_rules"):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(documents[r.doc_id].text)


def test_decontamination(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id): r.shared for r in rows(spark, "op10_decontamination")}
    assert found == brute.contained([(i, r.text) for i, r in documents.items()], items)


def test_rates(spark, documents):
    found = rows(spark, "op3_soft_mixing")
    assert sorted(r.doc_id for r in found) == sorted(documents) and all(r.rate >= 0 for r in found)


@pytest.mark.parametrize("targets", [None, {"toxic0": 0.999, "toxic1": 0.001}])
def test_last_stage_reaches_its_targets(spark, monkeypatch, targets):
    assert corpus_pipeline.TARGETS == {"toxic0": 0.96, "toxic1": 0.04}
    monkeypatch.setattr(corpus_pipeline, "TARGETS", targets or corpus_pipeline.TARGETS)
    made = []
    solve = mixing.solve
    monkeypatch.setattr(mixing, "solve", lambda *a: made.append(solve(*a)) or made[-1])
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id % 3 > 0")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic is not null").selectExpr("doc_id", "concat('toxic', toxic) as domain")
    kept = {r.doc_id: r.rate for r in corpus_pipeline.mixture(spark, docs, SF_DIR).collect()}
    every = mixing.mixing_rates(docs, labels, corpus_pipeline.TARGETS).collect()
    p, n = np.array([r.posterior for r in every]), np.array([r.n_tokens for r in every], dtype=float)
    rate = np.array([r.rate for r in every])
    assert made[0].met and made[0].domains == ["toxic0", "toxic1"]
    share = (rate * n) @ p / n.sum()
    assert np.abs(share - [corpus_pipeline.TARGETS[d] for d in made[0].domains]).max() < 1e-6
    assert {r.doc_id: r.rate for r in every if r.copies} == pytest.approx(kept)
    if targets:
        assert (rate == 0).any()


def test_op3_reaches_its_targets(spark):
    found = rows(spark, "op3_soft_mixing")
    total = np.array([r.rate * r.n_tokens for r in found]) @ np.array([r.posterior for r in found])
    assert sorted(total / total.sum()) == pytest.approx(sorted(MIX_TARGETS.values()), abs=1e-6)


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    verdict = {r.doc_id: r.kept for r in rows(spark, "op8_quality_rules")}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_DIR), "stage")
        after = {r.doc_id: r for r in docs.collect()}
        if name == "quality rules":
            assert set(after) == {i for i in before if verdict[i]}
        elif name == "n-gram Jaccard join":
            plain = brute.jaccard_components([(i, r.text) for i, r in before.items()])
            assert set(after) == set(plain.values())
        elif name == "benchmark decontamination":
            dirty = {i for i, _ in brute.contained([(i, r.text) for i, r in before.items()], items)}
            assert set(after) == set(before) - dirty
        elif name == "secret scans":
            assert {i: (r.text, r.n_chars) for i, r in after.items()} == {
                i: (secret_scan.redacted(r.text), len(secret_scan.redacted(r.text))) for i, r in before.items()}
        else:
            assert set(after) <= set(before) and all(r.copies >= 1 for r in after.values())
            assert docs.columns == [*columns, "n_tokens", "rate", "copies"]
            break
        assert docs.columns == columns
