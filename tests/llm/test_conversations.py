"""Operator 11 against a uniform-cost search over whole conversations, written from the contract alone."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from media_forecast.llm import conversations as C


def best_repair(rows):
    """(cost, audit, lines) of [(role, text, fault)]; states are the role initials so far in the pattern (s?(ua)+)?."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        if (k, state) in done:
            continue
        done.add((k, state))

        def put(c, letter, k2, role=None, text="", initial=None):
            initial = initial if initial is not None else (role or "")[:1]
            s2 = state if role is None else after.get((state, initial))
            if s2 is not None:
                heapq.heappush(heap, (cost + c, audit + letter, k2, s2, lines if role is None else (*lines, f"{role}:{text}")))

        for role in ("user", "assistant"):
            put(3, "I", k, role)
        if k < len(rows):
            role, text, fault = rows[k]
            put(4, "D", k + 1)
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                put(extra, "K", k + 1, role, text)
                for new in ("user", "assistant"):
                    put(extra + 3, "R", k + 1, new, text)
    raise AssertionError


def brute(table):
    """The contract's rows, sorted."""
    out = []
    for conv in sorted({r[0] for r in table}, key=str):
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            null = lambda x: " " if x is None else x
            hit = zlib.crc32(f"{null(conv)}:{null(turn)}".encode()) % 20
            role, text = null(role), null(text)
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            role = "user" if hit == 4 else role
            rows += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = best_repair(marked)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, fault string").repartition(4)


def random_rows(conv, n, r, turns=None):
    texts = ["Yes.", "No!", "Why?  \n", "broken", "", " \t", "Née. x", "a. ", "é?\x85", None, *(f"t{k}." for k in range(20)), *(f"b{k}" for k in range(8))]
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None, "Unknown", "User"]
    return [(conv, r.choice(turns) if turns else k, r.choice(roles), r.choice(texts)) for k in range(n)]


def test_equal_to_uniform_cost_search(spark):
    r = random.Random(4)
    rows = []
    for conv in range(120):
        rows += random_rows(conv, r.randint(1, 14), r)
    for conv in range(120, 160):
        rows += random_rows(conv, r.randint(1, 12), r, [None, 0, 1, 1, 2, 5, 9])  # null, equal and missing turns
    rows += random_rows(None, 9, r)
    rows += [(500, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(900)]  # several segments and tasks
    rows += random_rows(501, 700, r)
    rows += [(502, k, "user", "same") for k in range(300)]
    rows += [(503, t, "system", "S.") for t in range(40) if zlib.crc32(f"503:{t}".encode()) % 20 == 0]  # every row is dropped
    rows += [(504, 0, "user", "long " * 300_000 + "."), (504, 1, "assistant", "ok.")]
    got = sorted(map(tuple, C.damaged_and_repaired(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert C.damaged_and_repaired(frame(spark, random_rows(1, 3, random.Random(0))).limit(0)).count() == 0


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, C.damaged_and_repaired(table).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("alphabet", ["suaxSUAX-", "UA", "ua", "sS", "X-", "uuA"])
def test_search_equals_every_choice(alphabet):
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    r = random.Random(alphabet)
    for n in [*range(7)] * 8 + [64] * 4:
        symbols = "".join(r.choice(alphabet) for _ in range(n))
        rows = [(roles.get(c.lower(), "user"), "t", "blank" if c == "-" else "truncated" if c.isupper() else None) for c in symbols]
        assert C.cheapest(symbols, C.START, C.ACCEPT) == best_repair(rows)[:2]


def test_bounds_are_never_above_the_cost():
    r = random.Random(3)
    for _ in range(200):
        symbols = "".join(r.choice("suaxSUAX-") for _ in range(r.randint(0, 9)))
        low = C.lower_bounds(symbols, C.ACCEPT)
        for state in C.STATES:
            found = C.cheapest(symbols, state, C.ACCEPT)
            assert found is None or low[0][state] <= found[0]
