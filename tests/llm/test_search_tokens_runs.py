"""Ranked search, token counts and run detection against plain restatements, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from signalbox.llm import lexical_search, periodic_runs, token_counts  # noqa: E402
from signalbox.llm.queries import QUERIES, with_planted_runs  # noqa: E402
from signalbox.llm.textkit import SPACE, words  # noqa: E402
from tests.llm.brute import ALNUM_WORD, SPACE_WORD, lower_ascii  # noqa: E402
from tests.llm.conftest import prose  # noqa: E402

SF_DIR = os.environ.get("SIGNALBOX_TEST_SF", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


# Ranked lexical search

def ranking(rows, items, k=10):
    docs = [(i, Counter(ALNUM_WORD.findall(lower_ascii(t)))) for i, t in rows]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    found = []
    for item, text in items:
        scored = []
        for i, c in docs:
            if not c:
                continue
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(ALNUM_WORD.findall(lower_ascii(text))) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        found += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=repr)


def listed(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def make_items(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, 0) for i, t in rows], "item_id long, text string, id string, n int, block int")

    return make


def test_ranking_of_odd_rows(make_docs, make_items, odd_rows):
    items = [(1, "One two SEVEN, seven"), (2, None), (3, ""), (4, "!!"), (5, "ñandú 12 w3 w4"), (5, "w1 w2"), (None, "x one"), (7, "nowhere")]
    found = lexical_search.ranked(make_docs(odd_rows), make_items([*items, items[0]]))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert listed(found) == ranking(odd_rows, items)


def test_ranking_of_empty_tables(make_docs, make_items):
    assert listed(lexical_search.ranked(make_docs([]), make_items([(1, "a")]))) == []
    assert listed(lexical_search.ranked(make_docs([(1, "a")]), make_items([]))) == []
    assert listed(lexical_search.ranked(make_docs([(1, None), (2, "")]), make_items([(1, "a")]))) == []


@pytest.fixture(scope="module")
def crowd():
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randrange(5, 60)) + rng.choices(rare, k=rng.randrange(0, 6)))) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]
    items = [(j, " ".join(rng.choices(common, k=6) + rng.choices(rare, k=3))) for j in range(90)] + [(90, rows[7][1])]
    return rows, items


def test_ranking_of_a_crowd_in_blocks_and_partitions(make_docs, make_items, crowd):
    rows, items = crowd
    plain = ranking(rows, items)
    docs = make_docs(rows)
    assert listed(lexical_search.ranked(docs, make_items(items))) == plain
    assert listed(lexical_search.ranked(docs.repartition(7), make_items(items), block_terms=150)) == plain
    assert listed(lexical_search.ranked(docs, make_items(items), k=1)) == ranking(rows, items, 1)


def _posted(rows, items, k=10):
    block = next(lexical_search.item_blocks(_Items(items), 1 << 20))
    w = words(pa.array([t for _, t in rows]), lexical_search.NOT_ALNUM)
    at = np.minimum(np.searchsorted(block.vocabulary, w.hash), len(block.vocabulary) - 1)
    known = block.vocabulary[at] == w.hash
    pair, tf = np.unique(w.doc[known] * len(block.vocabulary) + at[known], return_counts=True)
    doc, term = pair // len(block.vocabulary), pair % len(block.vocabulary)
    df = np.bincount(term, minlength=len(block.vocabulary))
    tree = lexical_search.Hierarchy(block, lexical_search.weights(df, len(rows)))
    value = lexical_search.impacts(tf, w.count[doc], len(rows), int(w.count.sum()))
    return tree, lexical_search.Best(tree.size, k), np.array([i for i, _ in rows]), doc, term, value


class _Items:
    def __init__(self, rows):
        self.rows = rows

    def toLocalIterator(self):
        return [{"item": i, "text": t} for i, t in self.rows]


def test_bounds_prune_without_loss(crowd):
    rng = random.Random(9)
    rows, items = crowd
    # Documents of many topics: an item's terms stand in few nodes, so most pairs of leaves are never scored.
    topics = [(5000 + i, " ".join(f"t{i % 120}x{rng.randrange(6)}" for _ in range(20))) for i in range(6000)]
    about = [(200 + t, f"t{t}x0 t{t}x1 t{t}x2 t{t}x3") for t in range(100)]
    rows, items = rows + topics, items + about
    tree, best, ids, doc, term, value = _posted(rows, items)
    done = lexical_search.search(tree, best, ids, np.zeros(len(ids), dtype=bool), doc, term, value)
    pairs = -(-len(rows) // lexical_search.FAN_OUT) * tree.widths[1]
    assert done < pairs / 2
    order = np.array(tree.order)
    found = {}
    for item, score, i in zip(order[best.item], best.score, best.id):
        found.setdefault(items[item][0], []).append((i, score))
    plain = {}
    for item, _, i, score in sorted(ranking(rows, items), key=lambda r: (r[0], r[1])):
        plain.setdefault(item, []).append((i, score))
    assert found == plain


def test_batches_one_after_the_other(crowd):
    rows, items = crowd
    tree, best, ids, doc, term, value = _posted(rows, items)
    null = np.zeros(len(ids), dtype=bool)
    whole = lexical_search.Best(tree.size, 10)
    lexical_search.search(tree, whole, ids, null, doc, term, value)
    for low in range(0, len(rows), 130):
        own = (doc >= low) & (doc < low + 130)
        lexical_search.search(tree, best, ids, null, doc[own], term[own], value[own])
    assert (best.item == whole.item).all() and (best.score == whole.score).all() and (best.id == whole.id).all()


# Token counts

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def count(library):
    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    return token_counts.counter(definition, token_counts.proven_tokens(library), token_counts.added_tokens(definition))


def tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@needs_tables
def test_tokens_of_documents(spark, library):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = QUERIES["op12_token_counts"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in found} == {
        i: (len((t or "").encode()), n := tokens(library, t), n > 512) for i, t in documents.items()}


def test_tokens_of_odd_rows(make_docs, odd_rows, library):
    rows = [*odd_rows, (20, "<|endoftext|>a<|endoftext|>"), (21, "<|endoftext|>" * 9), (22, "a\n\n\n b\t\t c  "), (23, "it's we'LL ՘ \U00010940x")]
    found = token_counts.token_counts(make_docs(rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    plain = [(i, len((t or "").encode()), n := tokens(library, t), n > 512) for i, t in rows]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found))) == sorted(map(repr, plain))
    assert token_counts.token_counts(make_docs([]), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "中", "\U0001f600", " ", "\u0085", "՘", "₏", "the", "<|endoftext|>", "<|"])))
def test_tokens_of_any_text(library, count, monkeypatch_block, parts):
    text = "".join(parts)
    assert count(text) == tokens(library, text)


@pytest.fixture(scope="module")
def monkeypatch_block():
    before, token_counts.BLOCK = token_counts.BLOCK, 7
    yield
    token_counts.BLOCK = before


def test_proven_strings_are_one_token_and_nearly_all(library):
    proven = token_counts.proven_tokens(library)
    assert len(proven) > 0.98 * library.get_vocab_size()
    assert all(tokens(library, t) == 1 for t in random.Random(1).sample(proven, 2000))


def test_long_pieces_take_little_more_than_linear_time(count, library):
    long = "x" * 300_000
    assert count(long) == tokens(library, long)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.added_tokens(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


# Run detection

def plain_runs(w):
    """Every maximal stretch of smallest period q and max(6, 4q) words, tried period by period."""
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(s <= i and i + length <= s + m and p < q for (s, m), p in found.items()):
                found[i, length] = q
            i = j + 1
    return sorted((s, m, p) for (s, m), p in found.items())


def collapsed(w, runs):
    dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def array_runs(texts):
    w = words(pa.array(texts, type=pa.string()), SPACE, fold=False)
    doc, start, length, period = periodic_runs.runs(w.hash, w.doc)
    found = [[] for _ in texts]
    for d, s, m, p in zip(doc, start - w.first[doc], length, period):
        found[d].append((int(s), int(m), int(p)))
    return found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70), max_size=4))
def test_runs_of_two_words(texts):
    assert array_runs([" ".join(t) for t in texts]) == [plain_runs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=25), st.integers(1, 9)), max_size=5))
def test_runs_of_repeated_phrases(phrases):
    w = [x for phrase, times in phrases for x in phrase * times]
    assert array_runs([" ".join(w)]) == [plain_runs(w)]


def test_runs_where_every_short_gram_recurs_within_the_period():
    rng = random.Random(3)
    period = [rng.choice("ab") for _ in range(400)]
    w = ["x"] + period * 4 + period[:37] + ["y"]
    assert (1, 1637, 400) in array_runs([" ".join(w)])[0]
    assert array_runs([" ".join(w)]) == [plain_runs(w)]


def test_runs_of_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, (30, "A a " * 9), (31, "a " * 5), (32, "a\t" * 6 + "b c b c b c b c"), (33, "z z z z z z " * 30_000)]
    found = periodic_runs.periodic_runs(make_docs(rows)).collect()
    assert len(found) == len(rows)
    seen = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found)
    plain = []
    for i, t in rows:
        w = SPACE_WORD.findall(t or "")
        runs = [(0, len(w), 1)] if i in (33,) else [] if len(w) > 5000 else plain_runs(w)
        plain.append((i, len(w), tuple(runs), collapsed(w, runs)))
    assert seen == Counter(plain)
    assert periodic_runs.periodic_runs(make_docs([])).collect() == []


def test_periodic_text_takes_little_more_than_linear_time():
    long = array_runs(["a b c " * 300_000])[0]
    assert long == [(0, 900_000, 3)]
    fibonacci = ["a", "a b"]
    while len(fibonacci) < 24:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    assert array_runs([fibonacci[-1]]) == [[]]


def planted(i, w):
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return w[:a] + [w[a + j % p] for j in range(len(w) - a)]


def test_planting(make_docs):
    rows = [(i, prose(i, i % 90)) for i in range(300)]
    found = {r.doc_id: SPACE_WORD.findall(r.text) for r in with_planted_runs(make_docs(rows)).collect()}
    assert found == {i: planted(i, SPACE_WORD.findall(t)) for i, t in rows}
    odd = [(None, "a b"), (3, None), (13, ""), (None, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in with_planted_runs(make_docs(odd)).collect()))) == sorted(map(repr, odd))


@needs_tables
def test_runs_of_documents(spark):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    some = 0
    for r in QUERIES["op13_periodic_runs"](spark, SF_DIR).collect():
        w = planted(r.doc_id, SPACE_WORD.findall(documents[r.doc_id] or ""))
        if len(w) > 1500:
            continue
        runs = plain_runs(w)
        some += bool(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{p}\n" for s, m, p in runs))
        assert r.collapsed_sha256 == sha(collapsed(w, runs))
    assert some > 5
