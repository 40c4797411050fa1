"""Order MinHash fingerprints against a plain version, and their sense of order and edits."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash

from tideframe.llm import order_minhash as O
from tideframe.llm import queries as Q


def hashed(*values):
    """Spark's xxhash64 of strings, ints and longs, one after another; values that are None do not count."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[1].to_bytes(4 if v[0] == "int" else 8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def longs(*values):
    return hashed(*(("long", v) for v in values))


def codes(units, k):
    if not units:
        return {}
    grams = [units[i : i + k] for i in range(max(1, len(units) - k + 1))]
    if k == 3:
        hs = [hashed(*g) for g in grams]
    else:
        pair = [hashed(*units[i : i + 2]) for i in range(len(units))]
        hs = [longs(*pair[i : i + 6 : 2]) for i in range(len(grams))]
    seen, bins = {}, {}
    for i, h in enumerate(hs):
        o = seen[h] = seen.get(h, -1) + 1
        g = hashed(("long", h), ("int", o)) if o else h
        bins.setdefault((g % (1 << 64)) >> 58, []).append((g, i))
    out = {}
    for b, v in bins.items():
        out[b] = longs(*(hs[i] for i in sorted(i for _, i in sorted(v)[:2]))) & 65535
    return out


def both(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return codes(list(text), 6) if len(text) < 1024 else None, codes(words, 3) if len(text) >= 256 else None


def written(pair):
    # bins in the order of their signed hashes
    one = lambda c: "".join(f"{b:02x}{c[b]:04x}" for b in sorted(c, key=lambda b: (b < 32, b))) if c else ""
    return f"{one(pair[0])}:{one(pair[1])}"


def near(a, b):
    if written(a) == written(b):
        return 1.0
    for x, y in zip(a, b):
        if x is not None and y is not None:
            bins = set(x) | set(y)
            return sum(x.get(k) == y.get(k) for k in bins) / len(bins) if bins else 0.0
    return 0.0


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1])))
    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, e, n = both(t), both(edited), both(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(e), near(a, e), near(a, n)))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_version(spark, data, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"{data}/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = found(Q.QUERIES["op12_order_minhash"](spark, f"{data}/{sf}"))
    assert got == expected(rows)
    assert len({(r[3], hash(t)) for r, t in zip(sorted(got), (t for _, t in sorted(rows)))}) == len({t for _, t in rows})
    long = [r for r in got if r[1] >= 60]
    assert sum(r[5] for r in long) / len(long) > 0.3 and sum(r[5] > r[6] for r in long) / len(long) > 0.9


@pytest.mark.parametrize("size", [500, 3])
def test_hard_rows_in_ranges(spark, size):
    rng = random.Random(5)
    rows = [(None, "lost"), (None, None), (7, ""), (7, "a"), (8, "é😀x" * 90), (9, " \n"), (10, "word " * 3000), (11, "y" * 5000), (11, "y" * 5000)]
    rows += [(20, f"hot {k} " * rng.randint(1, 9)) for k in range(40)] + [(rng.choice([19, 21, 22, 10**12, -5]), "".join(rng.choices("ab c", k=rng.randint(0, 40)))) for _ in range(40)]
    df = spark.createDataFrame([(d, t, 1, True) for d, t in rows], "doc_id long, text string, h int, copy boolean")
    got = found(O.edited_fingerprints(df, size))
    assert len(got) == len(rows) and got == expected(rows)


def test_single_and_empty(spark):
    one = spark.createDataFrame([(3, "only this one document")], "doc_id long, text string")
    assert found(O.edited_fingerprints(one)) == expected([(3, "only this one document")])
    assert O.edited_fingerprints(one.limit(0)).count() == 0


def test_order_and_repetition_count(spark):
    """The same words in another order, or more often, are not alike; a small edit is."""
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    mixed = [w for k in rng.sample(range(100), 100) for w in words[30 * k : 30 * k + 30]]
    edited = words[:1500] + ["new"] + words[1501:]
    rows = [(0, " ".join(words)), (1, " ".join(mixed)), (2, " ".join(edited))]
    prints = {r["doc_id"]: r["fingerprint"] for r in O.order_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    part = lambda d: {prints[d].split(":")[1][k : k + 6] for k in range(0, 384, 6)}
    assert len(part(0) & part(2)) > 55 and 15 < len(part(0) & part(1)) < 48
