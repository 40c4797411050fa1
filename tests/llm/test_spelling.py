"""Spelling variants against all pairs of a vocabulary."""

import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import queries as Q
from tideframe.llm import spelling_variants as S


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def counts(rows, typos=199):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if typos and h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def brute(n, times=5):
    """All pairs: a word's near words differ in one place of a wildcard or are one letter longer or shorter."""
    near = {w: set() for w in n}
    by = {}
    for w in n:
        for k in range(len(w)):
            by.setdefault((w[:k], w[k + 1 :]), []).append(w)
    for (a, b), group in by.items():
        for w in group:
            near[w] |= set(group) - {w}
            if (short := a + b) in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_brute_force_itself():
    words = ["abcdef", "abcdeg", "abcde", "abcdefg", "xbcdef", "bcdef", "abdcef"]
    got = brute(dict.fromkeys(words, 1))
    assert {w: v[3] for w, v in got.items()} == {w: sum(one_edit(w, x) for x in words) for w in words}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, data, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"{data}/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    n = {w: k for w, k in counts(rows).items() if len(w) >= 6 and k >= 5}
    got = found(Q.QUERIES["op13_spelling_variants"](spark, f"{data}/{sf}"))
    assert got == brute(n) and any(v[0] for v in got.values())


def test_hard_texts(spark):
    rows = [(1, None), (2, ""), (None, "Grüße GRÜSSE grüße ×÷éèêë"), (3, "straßen strassen " * 40 + "straßen1straßem"), (3, "Ābcdefg ÿÿÿÿÿÿ " * 7), (4, "x" * 50000 + " aaaaaa aaaaaaa aaaaaaaa " * 5)]
    df = spark.createDataFrame([(*r, "w", 7) for r in rows], "doc_id long, text string, word string, n int")
    n = {w: k for w, k in counts(rows).items() if len(w) >= 6 and k >= 5}
    assert n and found(S.spelling_variants(df, typos=199)) == brute(n)
    assert found(S.spelling_variants(df.limit(0))) == {} and found(S.spelling_variants(df.where("doc_id < 3"))) == {}


def test_crowded_buckets_and_chains(spark):
    """With a limit of three words all buckets are cut down to single letters; forms lead over several steps."""
    import itertools

    words = {"stem" + "".join(x) + y: 1 + k % 700 for k, (x, y) in enumerate(itertools.product(itertools.product("abc", repeat=4), ("", "end", "ends")))}
    words |= {"abcdefgh": 10**6, "abcdefgi": 10**5, "abcdefhi": 10**4, "abcdeghi": 10**3, "abcdghi": 10}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute(words)
    assert found(S.variants(df, limit=3)) == want == found(S.variants(df))
    assert want["abcdghi"][1] == "abcdefgh"


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text("abé", min_size=3, max_size=4), max_size=40), st.booleans())
def test_scan_of_sorted_words(words, last):
    words = sorted(words)
    want = set()
    for i, x in enumerate(words):
        for j in range(i + 1, len(words)):
            short, long = sorted((x, words[j]), key=len)
            if one_edit(x, words[j]) and len(short) == 3 and (len(long) == 3 or last or not long.startswith(short)):
                want.add((i, j))
    got = list(S.near_in(words, 3, last))
    assert len(got) == len(set(got)) and set(got) == want
