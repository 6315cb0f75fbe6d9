"""Queries without SQL against plain versions over whole rows, on texts that differ only late."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinloom.functions import similarity
from kinloom.operators import blocking
from kinloom.plans import catalogue, fixtures
from kinloom.plans.records import record

#: The first 240 characters are alike, so that whatever tells the texts apart comes after them.
HEAD = " ".join(f"common{i:02d}" for i in range(27))[:240]


def late_texts() -> list[tuple[int, str]]:
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    return [(i, f"{HEAD} {' '.join(r.choice(vocabulary) for _ in range(12 + i))}") for i in range(12)]


@pytest.fixture
def sf(spark, tmp_path):
    rows = [(i, t, "en", "x", len(t)) for i, t in late_texts()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def by_pair(spark, sf, name):
    return {(r.qid, r.tid): r for r in catalogue.queries()[name](spark, sf).collect()}


def partial_brute(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    return max(similarity.indel(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))


def jaro_winkler_brute(a: str, b: str) -> float:
    if a == b or not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@settings(max_examples=300, deadline=None)
@given(st.text("abé ", max_size=14), st.text("abé ", max_size=14))
def test_partial_and_jaro_winkler_are_exact(a, b):
    assert similarity.partial(a, b) == partial_brute(a, b)
    assert similarity.jaro_winkler(a, b) == jaro_winkler_brute(a, b)


def test_pair_similarities_see_whole_texts(spark, sf):
    texts = dict(late_texts())
    ratios, features, sets = (by_pair(spark, sf, n) for n in ("sim_ratios_whole", "feat_text_contract_whole", "sim_token_sets_whole"))
    assert ratios and ratios.keys() == features.keys() == sets.keys()
    for (q, t), r in ratios.items():
        a, b = texts[q], texts[t]
        assert r.ratio == round(similarity.indel(a, b), 6) and r.partial == round(partial_brute(a, b), 6)
        x, y = set(a.split()), set(b.split())
        assert sets[q, t].jaccard == features[q, t].jaccard == round(len(x & y) / len(x | y), 6)
        assert features[q, t].equal == int(a == b) and features[q, t].length_gap == len(a) - len(b)
        assert features[q, t].jw == round(jaro_winkler_brute(a, b), 6)
    assert all(r.ratio < 100 for r in ratios.values())


def test_names_of_records_are_compared_whole(spark):
    sf = "/root/testdata/sf0.001"
    pairs = {(r.qid, r.tid): r for r in record(spark, sf, "rec_pairs").collect()}
    ratios, features = (by_pair(spark, sf, n) for n in ("sim_ratios", "feat_text_contract"))
    assert pairs and pairs.keys() == ratios.keys() == features.keys()
    for k, p in pairs.items():
        assert ratios[k].ratio == round(similarity.indel(p.a, p.b), 6) and ratios[k].partial == round(partial_brute(p.a, p.b), 6)
        assert features[k].equal == int(p.a == p.b) and features[k].jw == round(jaro_winkler_brute(p.a.lower(), p.b.lower()), 6)


def test_words_after_the_head_are_witnesses(spark, sf):
    texts = dict(late_texts())
    got = by_pair(spark, sf, "block_rare_witness_whole")
    targets = [i for i in texts if i != 0]
    for t in targets:
        assert got[0, t].witnesses == len(set(texts[0].split()) & set(texts[t].split()))
    cover = by_pair(spark, sf, "sim_idf_overlap_whole")
    assert all(0 < r.ref_cover < 1 for r in cover.values())


def test_normalised_texts_and_edges_are_whole(spark, sf):
    texts = dict(late_texts())
    rows = catalogue.queries()["norm_compatible"](spark, sf).collect()
    assert {r.id: r.nm for r in rows} == {r.id: r.folded for r in rows} == texts
    edges = catalogue.queries()["graph_mutual_topk_whole"](spark, sf).collect()
    assert edges
    for e in edges:
        x, y = set(texts[e.src].split()), set(texts[e.dst].split())
        assert e.weight == round(len(x & y) / len(x | y), 6) < 1
    assert catalogue.queries()["graph_components_whole"](spark, sf).count() == len({e.src for e in edges})


def cosines(refs, targets, tokens, least):
    """Cosine by all tokens that references have, and whether a token of few enough references is shared."""
    counts = {k: Counter(tokens(t)) for k, t in (refs | targets).items()}
    df = Counter(w for q in refs for w in counts[q])
    idf = {w: math.log((len(refs) + 1) / (n + 1)) + 1 for w, n in df.items() if n >= least}

    def vector(key):
        v = {w: (1 + math.log(n)) * idf[w] for w, n in counts[key].items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    most, vectors = max(least, min(2000, len(refs) * 3 // 100)), {k: vector(k) for k in counts}
    out = {}
    for t in targets:
        for q in refs:
            x, y = vectors[q], vectors[t]
            out[t, q] = round(sum(w * y[k] for k, w in x.items() if k in y), 6), any(df[k] <= most for k in x.keys() & y.keys())
    return out


@pytest.fixture
def many(spark, tmp_path):
    """Sixty references of which all share common words, and copies with late changes."""
    r = random.Random(3)
    texts = {i: f"{i:03d} {HEAD} rare{i} pair{i // 2} mid{i % 3} {' '.join(r.choice(['x', 'y', 'z']) for _ in range(5))}" for i in range(60)}
    texts |= {100 + i: f"{texts[i]} late{i}" for i in range(1, 60, 7)}
    rows = [(i, t, "en", "x", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), texts


def test_common_words_count_in_scores_but_make_no_candidates(spark, many):
    path, texts = many
    sides = {n: {r[0]: texts[r[0]] for r in fixtures.part(spark, path, n).collect()} for n in ("refs", "targets")}
    for name, tokens, least, k in (
        ("block_char_ngram_whole", lambda t: [t[i : i + 4] for i in range(len(t) - 3)], 2, 3),
        ("block_token_tfidf_whole", lambda t: set(t.split()), 1, 5),
    ):
        want = cosines(sides["refs"], sides["targets"], tokens, least)
        got = {(r.tid, r.qid): r.score for r in catalogue.queries()[name](spark, path).collect()}
        for t in sides["targets"]:
            best = sorted(-s for (u, q), (s, near) in want.items() if u == t and near)[:k]
            assert sorted(-s for (u, q), s in got.items() if u == t) == pytest.approx(best, abs=2e-6)
        assert got == pytest.approx({p: want[p][0] for p in got}, abs=2e-6) and all(want[p][1] for p in got)
    again = {(r.tid, r.qid): r.score for r in catalogue.queries()["block_rescore_whole"](spark, path).collect()}
    assert again == pytest.approx({k: want[k][0] for k in again}, abs=2e-6) and min(again.values()) > 0
    recall = catalogue.queries()["block_recall_whole"](spark, path).collect()
    assert {r.k: r.recall for r in recall} == {1: 1, 3: 1, 5: 1}


def test_cap_grows_with_the_input():
    assert [blocking.share_cap(n) for n in (10, 1000, 8524, 10**6)] == [1, 30, 255, 2000] and blocking.share_cap(10, 2) == 2


def test_all_languages_and_all_nations(spark, tmp_path):
    docs = [(1, "acme limited", "en"), (2, "la casa gmbh", "es"), (3, "und", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(7, 0), (8, 1), (9, 5), (10, None)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {n: dict(map(tuple, catalogue.queries()[n](spark, str(tmp_path)).collect())) for n in ("name_tokens_classified_all", "region_lookup")}
    assert got["name_tokens_classified_all"] == {"acme": 0, "limited": 1, "la": 2, "casa": 0, "gmbh": 1, "und": 2}
    assert got["region_lookup"] == {7: "A", 8: "B", 9: "", 10: ""}


def test_combing_is_exact_for_long_texts_and_many_letters():
    def plain(a, b):
        left, top = list(range(len(a))), list(range(len(a), len(a) + len(b)))
        for i in range(len(a)):
            for j in range(len(b)):
                r = len(a) - 1 - i
                if a[i] == b[j] or left[r] > top[j]:
                    left[r], top[j] = top[j], left[r]
        return [x - len(a) for x in top]

    r = random.Random(1)
    many = "".join(map(chr, range(500, 900)))
    for a, b in (("abcab", "xbcax"), ("".join(r.choice(many) for _ in range(300)), "".join(r.choice(many) for _ in range(420))), ("ab" * 40, "ba" * 33_000)):
        got = similarity.stretch_lengths(a, b)
        assert got.dtype == np.int64 and got.tolist() == plain(a, b)
