"""Conversation repair against a plain search over all edits."""

import hashlib
import re
import zlib
from functools import lru_cache

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import conversation_repair as C
from tideframe.llm import queries as Q

ROLES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def tie(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """Counts, cost, audit and digest of one damaged conversation, by search over whole edit strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, tie(r[2], r[3])))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, last, inserts):
        """(cost, audit, repaired rows) from row i on, after a kept role initial ``last``."""
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            new = "a" if last == "u" else "u"
            c, a, r = best(i, new, inserts + 1)
            found.append((c + 3, "I" + a, ((ROLES[new], ""), *r)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, r = best(i + 1, last, 0)
            found.append((c + 4, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                if last + role[:1] in ("s", "u", "su", "ua", "au") and role[:1]:
                    c, a, r = best(i + 1, role[0], 0)
                    found.append((c + late, "K" + a, ((role, text), *r)))
                new = "a" if last == "u" else "u"
                c, a, r = best(i + 1, new, 0)
                found.append((c + 3 + late, "R" + a, ((ROLES[new], text), *r)))
        return min(found) if found else (10**9, "", ())

    cost, audit, repaired = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{x: faults.count(x) for x in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
    }


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    return {c: brute(v) for c, v in by.items()}


def found(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_search(spark, data, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"{data}/{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    assert found(Q.QUERIES["op11_conversation_repair"](spark, f"{data}/{sf}")) == expected(rows)


HARD = [
    (1, None, "user", None), (1, None, None, "Yes."), (1, 3, "system", "Hi."), (1, 2, "assistant", "no end"), (1, 9, "tool", "x!"),
    (2, 0, "user", " \n\t"), (2, 0, "user", ""), (3, 5, "user", "same."), (3, 5, "user", "same."), (3, 6, "user", "same."), (3, 1, "assistant", "é?\x0b "),
    (None, 1, "user", "a."), (None, None, None, None), (4, 1, "", "no role."), (4, 2, "user", "q?"), (5, 7, "system", "s."), (6, 1, "assistant", "z." * 30000),
]


def test_hard_rows(spark):
    rows = HARD + [(100 + k, t, r, x) for k in range(60) for t, r, x in ((0, "system", "S."), (1, "assistant", "A"), (2, "user", "U!"), (2, "user", "V."), (4, "user", ""))]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "conv_id long, turn long, role string, text string, cost double, audit string")
    assert found(C.repair(C.damaged(df), digests=True)) == expected(rows)


def test_long_conversation_and_rows(spark):
    rows = [(1, t, ("user", "assistant", "user")[t % 3], f"t{t % 700}" + "." * (t % 2)) for t in range(3000)]
    df = spark.createDataFrame([r for r in rows], "conv_id long, turn long, role string, text string")
    edited = C.repair(C.prepared(df)).collect()
    kept = sorted((r for r in edited if r["at"] is not None), key=lambda r: r["at"])
    assert [r["at"] for r in kept] == list(range(len(kept))) and re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in kept))
    assert sum(r["edit"] != "I" for r in edited) == len(rows) and {r["text"] for r in edited if r["edit"] == "K"} <= {r[3] for r in rows}
    cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[r["edit"]] + 3 * (r["edit"] in "KR" and r["text"][-1] != ".") for r in edited)
    assert cost == C.repair_plans(C.prepared(df)).first()["cost"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(C.damaged(df), digests=True).count() == 0 and C.repair(C.prepared(df)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("suaoSUAOX", max_size=7), max_size=6))
def test_shared_ends(signatures):
    """Costs and audits do not depend on what was read before, and each end of the sorted signatures is made once."""
    automaton, ends = C.Automaton(), set()
    for s in sorted(x[::-1] for x in signatures):
        automaton.read(s)
        ends |= {s[:k] for k in range(1, len(s) + 1)}
        alone = C.Automaton()
        alone.read(s)
        assert automaton.best() == alone.best()
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
        rows = [(1, k, roles.get(x.lower(), "user"), "" if x == "X" else f"{k}" + "." * x.islower()) for k, x in enumerate(s[::-1])]
        want = brute(rows)
        assert automaton.best() == (want["cost"], want["audit"])
    assert automaton.made == len(ends)
