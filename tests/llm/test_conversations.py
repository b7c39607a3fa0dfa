import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from ledgerline.llm import conversations, queries

FOLDER = "/root/testdata/sf0.001"
SHAPE = re.compile(r"(s?(ua)+)?\Z")
BLANKS = " \t\n\v\f\r"


def faults_of(rows):
    """rows: (role, text) in order; 'b', 'd', 't' or '.' for each."""
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(BLANKS)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying all edits, cheaper ones of equal results first: a search over (row, state)."""
    faults = faults_of(rows)
    table = {(0, ""): (0, "", ())}  # by rows taken and initials so far in short: (cost, audit, messages)
    best = None

    def follow(initials):  # what stays of the initials: enough to know what may come
        return initials[-1:] if initials[-1:] != "s" else "s"

    def may(state, initial):
        return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    layer = {"": (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(3):  # added messages before row i
            for state, (cost, audit, made) in list(layer.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if may(state, initial):
                        new = (cost + 5, audit + "I", (*made, (role, "")))
                        if initial not in layer or new[:2] < layer[initial][:2]:
                            layer[initial] = new
        if i == len(rows):
            break
        (role, text), fault, after = rows[i], faults[i], {}
        for state, (cost, audit, made) in layer.items():
            ways = [(state, cost + 2, "D", made)]
            if fault not in "bd":
                more = 5 if fault == "t" else 0
                if may(state, role[:1] or "x"):
                    ways.append((role[:1], cost + more, "K", (*made, (role, text))))
                for initial, other in (("u", "user"), ("a", "assistant")):
                    if may(state, initial):
                        ways.append((initial, cost + 1 + more, "R", (*made, (other, text))))
            for behind, price, edit, messages in ways:
                if behind not in after or (price, audit + edit) < after[behind][:2]:
                    after[behind] = (price, audit + edit, messages)
        layer = after
    del table, follow
    for state in ("", "a"):
        if state in layer and (best is None or layer[state][:2] < best[:2]):
            best = layer[state]
    assert SHAPE.match("".join(role[:1] for role, _ in best[2]))
    return best


def by_all_sequences(rows):
    """The same by spelling out every sequence of edits, for a few rows."""
    faults, best = faults_of(rows), None
    adds = ["", "I", "II", "III"]
    for edits in itertools.product(*([a + e for a in adds for e in "DKR"] for _ in rows), adds):
        cost, initials = 0, ""
        ok = True
        for edit, (role, _), fault in itertools.zip_longest(edits, rows, faults, fillvalue=("", "")):
            for letter in edit:
                if letter == "I":
                    cost, initials = cost + 5, initials + ("a" if initials[-1:] == "u" else "u")
                elif letter == "D":
                    cost += 2
                else:
                    ok &= fault not in "bd"
                    cost += 5 * (fault == "t") + (letter == "R")
                    initials += (role[:1] or "x") if letter == "K" else "a" if initials[-1:] == "u" else "u"
        if ok and SHAPE.match(initials):
            best = min(best or (10**9, ""), (cost, "".join(edits)))
    return best


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "unknown", "User"]
    texts = ["Yes.", "No", "a b!", "", " \n", "What?", "end. ", " ."]
    weights = [8, 8, 3, 1, 1, 1, 1]
    return [(rng.choices(roles, weights)[0], rng.choice([*texts, *(f"{rng.random()}{rng.choice(['.', '', '!'])}" for _ in range(6))])) for _ in range(n)]


def in_one(rows):
    kinds = [(role[:1] if role[:1] in ("s", "u", "a") else "x") + fault for (role, _), fault in zip(rows, faults_of(rows), strict=True)]
    matrices = [conversations.MESSAGES[kind] for kind in kinds]
    behind = conversations.last_state(conversations.forward(matrices, conversations.START))
    return "".join(conversations.edits_between(kinds, conversations.START, behind)) + "I" * conversations.AT_THE_END[behind]


def test_the_two_brute_forces_agree():
    rng = random.Random(2)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(4))
        assert by_all_sequences(rows) == cheapest(rows)[:2]


def test_least_of_the_cheapest_edits():
    rng = random.Random(1)
    for _ in range(4000):
        rows = random_rows(rng, rng.choice([0, 1, 2, 3, 5, 8, 13, 40]))
        assert in_one(rows) == cheapest(rows)[1]


def test_matrices_of_stretches_lead_to_the_same_crossings():
    rng = random.Random(4)
    for _ in range(300):
        rows = random_rows(rng, 40)
        kinds = [(role[:1] if role[:1] in ("s", "u", "a") else "x") + fault for (role, _), fault in zip(rows, faults_of(rows), strict=True)]
        cut = [kinds[i : i + 7] for i in range(0, 40, 7)]
        matrices = [conversations.whole([conversations.MESSAGES[kind] for kind in part]) for part in cut]
        states = conversations.crossings(matrices, 0, conversations.last_state(conversations.whole(matrices)[0]))
        edits = [edit for part, a, b in zip(cut, states, states[1:], strict=False) for edit in conversations.edits_between(part, a, b)]
        assert "".join(edits) + "I" * conversations.AT_THE_END[states[-1]] == cheapest(rows)[1]


def damaged(rows):
    """rows: (conv_id, turn, role, text), as the tables have them; the same after the damage."""
    spaced = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        fault, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
        if fault:
            row = (conv, turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            yield from [row, row] if fault == 3 else [row]


def answers(rows, broken):
    first = lambda x: (x is not None, x)  # noqa: E731  nulls first
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in broken if r[0] == conv), key=lambda r: (first(r[1]), r[2], hashlib.sha256(r[3].encode()).digest()))
        turns = {r[1] for r in own} - {None}
        messages = [(role, text) for _, _, role, text in own]
        faults = faults_of(messages)
        cost, audit, made = cheapest(messages)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(messages))
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in made).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, "bdt"), illegal, cost, audit, digest))
    return sorted(map(repr, out))


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_conversation_repair(spark, FOLDER)
    assert found.columns == COLUMNS
    assert sorted(repr(tuple(r)) for r in found.collect()) == answers(rows, list(damaged(rows)))


def odd_rows():
    rng = random.Random(6)
    rows = [(conv, rng.choice([None, *range(12)]) if conv % 5 == 0 else turn, *message) for conv in range(40) for turn, message in enumerate(random_rows(rng, rng.randrange(8)))]
    rows += [(None, 1, "user", "Hi."), (None, 2, None, None), (None, None, "assistant", "x" * 300_000 + ".")]
    rows += [(77, turn, *message) for turn, message in enumerate(random_rows(rng, 900))]  # far more than a window
    rows += [(78, 3, "user", "Same.")] * 40
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("window", "group"), [(10, 13), (2, 1), (0, 2)])
def test_odd_conversations_over_many_tasks(spark, tmp_path, monkeypatch, window, group):
    monkeypatch.setattr(conversations, "WINDOW_BITS", window)
    monkeypatch.setattr(conversations, "GROUP_BITS", group)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], f"{SCHEMA}, conv string, pos int").repartition(5)
    df.write.parquet(os.path.join(tmp_path, "conversations.parquet"))
    found = queries.op12_conversation_repair(spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in found.collect()) == answers(rows, list(damaged(rows)))


def test_messages_in_windows_are_those_of_the_digest(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    repaired = conversations.repair(conversations.damage(df), df.selectExpr("conv_id AS conv").distinct())
    digests = {}
    for r in conversations.repaired_messages(repaired).orderBy("conv", "pos", "place").collect():
        digests.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    expected = {r["conv"]: r["repaired_sha256"] for r in conversations.reports(repaired).collect()}
    assert {conv: hashlib.sha256("\n".join(digests.get(conv, [])).encode()).hexdigest() for conv in expected} == expected


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(os.path.join(tmp_path, "conversations.parquet"))
    assert queries.op12_conversation_repair(spark, str(tmp_path)).count() == 0
