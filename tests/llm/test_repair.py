"""Conversation repair against a search over all edit sequences in plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from repocensus.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, pos string, fault string, block string"
BLANK, LANGUAGE = re.compile(r"[\x20\x09-\x0D]*"), re.compile(r"(s?(ua)+)?")


def _damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        for _ in range(0 if how == 0 else 2 if how == 3 else 1):
            yield conv, turn, "user" if how == 4 else role, text


def _sequences(rows, most):
    """Every (cost, audit, lines) of ``rows`` (role, text, fault) with at most ``most`` inserts, allowed or not."""
    if not rows:
        yield from ((5 * n, "I" * n, [*x]) for n in range(most + 1) for x in itertools.product(["user:", "assistant:"], repeat=n))
        return
    (role, text, fault), rest = rows[0], rows[1:]
    stay = 5 if fault == "truncated" else 0
    edits = [(2, "D", [])]
    if fault not in ("blank", "duplicate"):
        edits += [(stay, "K", [f"{role}:{text}"])] + [(1 + stay, "R", [f"{r}:{text}"]) for r in ("user", "assistant")]
    for n in range(most + 1):
        for new in itertools.product(["user:", "assistant:"], repeat=n):
            for (c, a, x), (cost, audit, lines) in itertools.product(edits, _sequences(rest, most - n)):
                yield 5 * n + c + cost, "I" * n + a + audit, [*new, *x, *lines]


def _cheapest(rows):
    """The least (cost, audit, lines) by a search from the left."""
    queue, done = [(0, "", 0, "0", [])], set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(rows) and state in "0a":
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        follow = {"0": "su", "s": "u", "u": "a", "a": "u"}[state]
        for r in follow.replace("s", ""):
            heapq.heappush(queue, (cost + 5, audit + "I", i, r, [*lines, {"u": "user:", "a": "assistant:"}[r]]))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, lines))
            stay = 5 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in follow:
                    heapq.heappush(queue, (cost + stay, audit + "K", i + 1, role[0], [*lines, f"{role}:{text}"]))
                for r in follow.replace("s", ""):
                    heapq.heappush(queue, (cost + stay + 1, audit + "R", i + 1, r, [*lines, ("user:" if r == "u" else "assistant:") + text]))


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        if BLANK.fullmatch(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = None if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def _expected(rows):
    """By conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    of = defaultdict(list)
    for r in _damaged(rows):
        of[r[0]].append(r)
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(of[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        faulty = _faults(own)
        cost, audit, lines = _cheapest(faulty)
        wrong = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        counts = [sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        want[conv] = (gaps, *counts, wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


def _compare(spark, rows):
    table = spark.createDataFrame([(*r, "p", None, "b") for r in rows], SCHEMA)
    got = repair.repair_query(table).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == _expected(rows)
    assert len(got) == len({r[0] for r in rows})


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    _compare(spark, rows)


def test_hostile_conversations(spark):
    draw = random.Random(5)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "ua"]
    texts = ["Good.", "no end", "Why?  \n", " \t", "", None, "é😀!", "x" * 30_000 + ".", "a\nb.", "."]
    rows = [(conv, draw.choice([None, *range(6)]), draw.choice(roles), draw.choice(texts)) for conv in [None, *range(60)] for _ in range(draw.randrange(7))]
    rows += [(70, 0, "user", "Same."), *[(71, None, "user", "Same.")] * 5, (72, None, None, None)]
    _compare(spark, rows + rows[:40])


@pytest.mark.parametrize("turns", [True, False])
def test_a_conversation_longer_than_blocks(spark, turns):
    """Thousands of rows of one conversation are parsed in many pieces; the null conversation is as long."""
    draw = random.Random(7)
    rows = [(conv, i if turns else None, draw.choice(["system", "user", "assistant", "user", "assistant", "x"]), f"Text {draw.randrange(2000)}{draw.choice('..,')}") for conv in (4, None) for i in range(1500)]
    _compare(spark, rows + [(9, 1, "user", "Hi."), (9, 2, "assistant", "Yes.")])


def test_the_search_is_the_least_of_all_sequences():
    draw = random.Random(3)
    for _ in range(150):
        rows = [(draw.choice(["system", "user", "assistant", "tool"]), str(i), draw.choice([None, None, "blank", "truncated"])) for i in range(draw.randrange(4))]
        allowed = (x for x in _sequences(rows, 3) if LANGUAGE.fullmatch("".join(line[0] for line in x[2])))
        assert min(allowed) == _cheapest(rows)


def test_every_split_gives_the_same_cell():
    draw = random.Random(1)
    for _ in range(40):
        kinds = "".join(draw.choice("suaoSUAOx") for _ in range(9))
        cells = {tuple(repair.joined(repair.parsed(kinds[:k]), repair.parsed(kinds[k:]))) for k in range(1, 9)}
        assert cells == {tuple(repair.parsed(kinds))}


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert repair.repair_query(table).collect() == []
