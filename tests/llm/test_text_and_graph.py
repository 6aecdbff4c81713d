from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from signalbox.llm import textkit
from signalbox.llm.graph import components
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé ñ\t\n\x0b.#1\U0001f600", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_shingle_sets_are_those_of_plain_words(texts):
    for separator, word in ((textkit.SPACE, brute.SPACE_WORD), (textkit.NOT_ALNUM, brute.ALNUM_WORD)):
        found = textkit.shingle_sets(pa.array(texts, type=pa.string()), 3, separator)
        plain = [brute.shingle_set(t, word, 3) for t in texts]
        assert [len(s) for s in found] == [len(s) for s in plain]
        for i in range(len(texts)):
            for j in range(i):
                assert len(set(found[i].tolist()) & set(found[j].tolist())) == len(plain[i] & plain[j])


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "", "b" * 100, "c"])})
    parts = list(textkit.slices(batch, "text", 16))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert list(textkit.slices(batch.slice(0, 0), "text")) == []


def test_components_of_a_long_chain_a_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 64)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    links = [*chain, *star, (5, 5), (None, 3), (2000, None)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == brute.components(chain + star, [*range(65), *range(1000, 1050)])


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
