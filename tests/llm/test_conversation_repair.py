"""Conversation repair against a plain search over edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from kestrelframe.llm import conversation_repair
from kestrelframe.llm.conversation_repair import DROPPED, MUST_GO, Repairer

SPACES = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """Cheapest ``(cost, audit)`` by the best suffix from each row and state; ``symbols`` as the operator codes them."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "a": (0, "")}  # by the last initial, for what is left from row k on
    for k in range(len(symbols), -1, -1):
        now = {last: [best[last]] if k == len(symbols) and last in best else [] for last in after}
        if k < len(symbols):
            s = symbols[k]
            for last, options in now.items():
                options.append((best[last][0] + 4, "D" + best[last][1]))
                if s != MUST_GO:
                    more = 3 * (s >= 4)
                    if "sua?"[s % 4] in after[last]:
                        cost, audit = best["sua?"[s % 4]]
                        options.append((cost + more, "K" + audit))
                    options += [(best[c][0] + more + 3, "R" + best[c][1]) for c in after[last] if c != "s"]
        for _ in range(4):
            for last, options in now.items():
                options += [(cost + 3, "I" + audit) for c in after[last] if c != "s" and now[c] for cost, audit in [min(now[c])]]
        best = {last: min(options) for last, options in now.items()}
    return best[""]


def enumerated(symbols, longest=2):
    """The same by listing every edit sequence with few insertions."""
    best = None
    for n in range(longest + 1):
        for letters in itertools.product("DKR", repeat=len(symbols)):
            for gaps in itertools.combinations_with_replacement(range(len(symbols) + 1), n):
                audit, cost, out, at, ok = "", 0, "", 0, True
                for k in range(len(symbols) + 1):
                    count = gaps.count(k)
                    for _ in range(count):
                        audit, cost, out = audit + "I", cost + 3, out + ("a" if out[-1:] == "u" else "u")
                    if k == len(symbols):
                        break
                    s, letter = symbols[k], letters[k]
                    audit += letter
                    if letter == "D":
                        cost += 4
                        continue
                    if s == MUST_GO:
                        ok = False
                        break
                    cost += 3 * (s >= 4) + 3 * (letter == "R")
                    out += ("a" if out[-1:] == "u" else "u") if letter == "R" else "sua?"[s % 4]
                if ok and LEGAL.fullmatch(out):
                    best = min(best or (cost, audit), (cost, audit))
    return best


def test_repair_is_the_cheapest_and_least():
    rng = random.Random(3)
    repairer = Repairer()
    for _ in range(150):
        symbols = [rng.choice([0, 1, 2, 1, 2, 3, 4, 5, 6, 7, MUST_GO]) for _ in range(rng.randint(0, 4))]
        # few insertions are ever useful for so few rows
        assert repairer.repair(bytes(symbols)) == enumerated(symbols, len(symbols)), symbols
    for _ in range(300):
        symbols = tuple(rng.choice([0, 1, 2, 1, 2, 3, 4, 5, 6, 7, MUST_GO]) for _ in range(rng.randint(0, 40)))
        assert repairer.repair(bytes(symbols)) == cheapest(symbols), symbols
    assert len(repairer.vectors) < 100  # normalised vectors recur


def brute(rows):
    said = lambda x: " " if x is None else str(x)
    by = {}
    for conv, turn, role, text in rows:
        mine = by.setdefault(conv, [])
        role, text = said(role), said(text)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, counts, symbols = set(), [0, 0, 0, 0], []
        for _, role, text in mine:
            bare = text.rstrip(SPACES)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            at = "sua".find(role[:1]) if role else 3
            symbols.append(MUST_GO if fault in (1, 2) else (3 if at < 0 else at) + 4 * (fault == 3))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit = cheapest(tuple(symbols))
        said_turns, last, k = [], "", 0
        for letter in audit:
            role, text = mine[k][1:] if letter != "I" else ("", "")
            k += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            said_turns.append(f"{role}:{text}")
        out.append((conv, gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(said_turns).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", "Go on!", "é 😀.", "猫", None, "a. b\t", "x" * 3000 + "."]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            rows += [(conv, rng.choice([turn, turn, turn, turn * 2, None]), role, rng.choice(texts) if rng.random() < 0.6 else f"Turn {turn}.")] * rng.choice([1, 1, 1, 2])
    rows += [(n, t, ("user", "assistant")[t % 2], f"Long {t % 97}.") for t in range(700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_plain_python(spark, tmp_path, seed):
    rows = rows_of(seed, 60)
    odd = [(*r, "clash", 5, True, b"z") for r in rows]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string, audit string, cost long, head boolean, digest binary").repartition(6).write.parquet(str(tmp_path / "conversations.parquet"))
    got = conversation_repair.query(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_all_rows_dropped_and_no_rows(spark, tmp_path):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(7, turn, "user", "Hi.")], schema).write.parquet(str(tmp_path / "a/conversations.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b/conversations.parquet"))
    assert list(map(tuple, conversation_repair.query(spark, str(tmp_path / "a")).collect())) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation_repair.query(spark, str(tmp_path / "b")).collect() == []


def test_repaired_turns_are_legal(spark):
    rows = spark.createDataFrame(rows_of(9, 30), "conv_id long, turn long, role string, text string")
    for r in conversation_repair.repair(conversation_repair.damaged(rows)).collect():
        assert LEGAL.fullmatch("".join(t[:1] for t in r.repaired)), r
    assert DROPPED not in range(MUST_GO + 1)
